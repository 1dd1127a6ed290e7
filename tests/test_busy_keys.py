"""Rate limits of keys that are spread over tasks, against those read in order."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.streaming import state


@pytest.mark.parametrize("seed", range(3))
def test_busy_keys_equal_those_in_order(spark, seed):
    r = random.Random(seed)
    # One key holds most requests, with equal times, gaps longer than windows, and times exactly a window apart.
    rows, t = [], {}
    for i in range(700):
        k = r.choice([1, 1, 1, 1, 2, None, 3])
        t[k] = t.get(k, 1_700_000_000_000_000) + r.choice([0, 1, 999_999, 1_000_000, 10_000_000, 20_000_000] + [75_000_000] * (seed == 1))
        rows.append((i, k, t[k]))
    df = spark.createDataFrame(rows, "id long, k long, us long").select("id", "k", F.timestamp_micros("us").alias("ts")).repartition(4)
    keys = lambda out: sorted((x["id"], x["allowed"], x["remaining"], x["retry_after"]) for x in out.collect())
    for limit, window in ((3, 10.0), (20, 60.0), (1, 0.5)):
        want = keys(state.rate_limit(df, "k", "ts", "id", limit, window))
        assert keys(state.rate_limit(df, "k", "ts", "id", limit, window, most=50)) == want
    assert {w[1] for w in want} == {True, False}


def test_one_key_is_read_by_several_tasks(spark):
    df = spark.range(4000).selectExpr("id", "'a' AS k", "timestamp_seconds(1700000000 + id * 7 % 4000) AS ts")
    flag = "spark.sql.adaptive.coalescePartitions.enabled"  # else Spark puts so few rows together
    spark.conf.set(flag, "false")
    try:
        out = state.rate_limit(df, "k", "ts", "id", 30, 60.0, most=100).where("allowed IS NOT NULL").withColumn("task", F.spark_partition_id())
        tasks = [x["count"] for x in out.groupBy("task").count().collect()]
    finally:
        spark.conf.unset(flag)
    assert sum(tasks) == 4000 and len(tasks) > 1, tasks
