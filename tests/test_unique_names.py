"""Unique names against taking them one by one, and a base name that is spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import catalog


def by_force(taken, wanted):
    out, used = {}, set(taken)
    given = {}
    for n, i in sorted(wanted, key=lambda x: x[1]):
        if n is None:
            out[i] = None
            continue
        k = given.get(n, 0)
        while (n if k == 0 else f"{n}_{k}") in used:
            k += 1
        out[i], given[n] = n if k == 0 else f"{n}_{k}", k + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_those_given_one_by_one(spark, seed):
    r = random.Random(seed)
    taken = [r.choice(["a", "b", "a_1", "é\nx"]) + r.choice(["", "", "_1", "_2", "_3", "_07", "_12", "_x", "_99999999999999999999"]) for _ in range(25)]
    wanted = [(r.choice(["a", "a", "a", "b", "c", "é\nx", "a_1", None]), i) for i in r.sample(range(1000), 60)]
    out = catalog.unique_names(spark.createDataFrame([(x,) for x in [*taken, None]], "user_name string"), spark.createDataFrame(wanted, "user_name string, user_id long").repartition(3))
    assert {x["user_id"]: x["user_name"] for x in out.collect()} == by_force(taken, wanted)


def test_one_base_name_for_all(spark):
    flags = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in flags.items():
        spark.conf.set(k, v)
    try:
        wanted = spark.range(3000).selectExpr("id AS user_id", "'same' AS user_name")
        taken = spark.range(500).selectExpr("concat('same_', id * 3 + 1) AS user_name")
        out = catalog.unique_names(taken, wanted).withColumn("task", F.spark_partition_id())
        rows = out.collect()
    finally:
        for k in flags:
            spark.conf.unset(k)
    assert len({x["task"] for x in rows}) > 1
    assert {x["user_id"]: x["user_name"] for x in rows} == by_force([f"same_{3 * i + 1}" for i in range(500)], [("same", i) for i in range(3000)])
