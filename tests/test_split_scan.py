"""Version files of several splits: members equal to those of a whole parse, read by several tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, scan

NASTY = ['"', "\\", '\\"', "}", "{", "[", "]", "},{", '"}', "\\\\", "é", "日本", "\n", ":", ",", '{"a":1}', "\\u007d", " "]


def value(r, depth=0):
    kind = r.random()
    if depth > 2 or kind < 0.5:
        return r.choice([None, True, 1, -2.5, 1e21, "".join(r.choice(NASTY) for _ in range(r.randrange(6)))])
    if kind < 0.7:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "b}", 'c"', "entities", "posts", "d\\"]): value(r, depth + 1) for _ in range(r.randrange(4))}


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def rows_of(df):
    return sorted((r["path"].rpartition("/")[2], r["_ord"], r["doc"]) for r in df.collect())


def test_members_of_splits_equal_those_of_whole_files(spark, tmp_path, tiny_splits):
    for seed in range(6):
        r = random.Random(seed)
        member = lambda: r.choice([1, "x}", None, [{"in": "a list"}], *[{"k": r.randrange(99), **{c: value(r) for c in "xyz"[: r.randrange(4)]}} for _ in range(12)]])  # noqa: B023, E731
        doc = {"total": 3, 'od"d{': {"entities": [{"not": "this"}]}, "entities": [member() for _ in range(r.randrange(30) if seed % 3 else 0)], "posts": [member() for _ in range(9)], "end": [[{}]]}
        if seed % 2:
            doc = dict(reversed(doc.items()))
        text = json.dumps(doc, ensure_ascii=bool(seed % 4), indent=seed % 5 or None)
        (tmp_path / f"f{seed:02}.json").write_text(text + "\n" * (seed % 2), encoding="utf-8", newline="")
    (tmp_path / "none.json").write_text('{"total": 0}' + " " * 200)
    path = str(tmp_path / "*.json")
    want = rows_of(readers.entities(spark, path))
    assert len({w[0] for w in want}) == 6 and len(want) > 40
    assert rows_of(readers.entities(spark, path, whole=0)) == want
    large = sum(f.stat().st_size > 900 for f in tmp_path.iterdir())
    assert 0 < large < 7
    assert rows_of(readers.entities(spark, path, whole=900)) == want


def test_one_file_is_read_by_several_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "one.json").write_text(json.dumps({"entities": [{"k": i, "t": "}" * (i % 7)} for i in range(120)]}))
    pieces = scan._pieces(spark, [str(tmp_path / "one.json")]).withColumn("task", F.spark_partition_id())
    tasks = pieces.groupBy("task").count().collect()
    assert len(tasks) > 5
    out = readers.entities(spark, str(tmp_path / "one.json"), whole=0)
    assert [(r["_ord"], json.loads(r["doc"])["k"]) for r in out.orderBy("_ord").collect()] == [(i, i) for i in range(120)]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
