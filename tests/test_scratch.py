"""Places in sorted files, what goes by them, and the entry without its optional subpackage."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from weftline.operators.query import QuerySpec, compile_json, compile_typed
from weftline.operators.versions import combined
from weftline.sources.scratch import fresh, numbered

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("a.b"))
    assert sorted((r["v"], r["_n"]) for r in numbered(rows, [F.col("v")]).collect()) == [(i, i) for i in range(1000)]
    got = {r["v"]: r["_n"] for r in numbered(rows, [F.col("v").desc()], size=F.col("v")).collect()}
    assert all(got[v] == sum(range(v + 1, 1000)) for v in range(1000))
    assert numbered(rows.limit(0), [F.col("v")]).count() == 0


def test_offset_without_limit(spark):
    rows = spark.range(50).select(F.col("id").alias("_ord"), (F.col("id") % 10).alias("v"), F.lit("x").alias("w"))
    want = sorted(((i % 10, i) for i in range(50)), reverse=False)[13:]
    got = compile_typed(QuerySpec(sort="v", offset=13), rows)
    assert [(r["v"], r["_ord"]) for r in got.collect()] == want
    docs = spark.range(9).select(F.col("id").alias("_ord"), F.concat(F.lit('{"a":'), F.col("id").cast("string"), F.lit("}")).alias("doc"))
    assert [r["_ord"] for r in compile_json(QuerySpec(offset=7), docs).collect()] == [7, 8]
    assert [r["_ord"] for r in compile_json(QuerySpec(offset=70), docs).collect()] == []


@pytest.mark.parametrize("spec, want", [({"offset": 3}, 6), ({"offset": 30}, 0), ({"offset": 3, "limit": 2}, 2), ({"limit": 5}, 5), ({"sample": 4, "offset": 1}, 3), ({}, 9)])
def test_counts_are_of_pages(spark, spec, want):
    rows = spark.range(9).select(F.col("id").alias("_ord"), F.lit(1).alias("v"))
    out = compile_typed(QuerySpec(count=True, **spec), rows)
    assert out.first()["count"] == want
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()


def test_combined_places_run_on(spark):
    queue = spark.createDataFrame([(k, k % 2, "proceed-version") for k in range(40)] + [(99, 7, "pending")], "queue_id long, dataset_id long, status string")
    extracts = spark.createDataFrame([(k, f"u{k}", [f'{{"k":{k},"i":{i}}}' for i in range(k % 4)]) for k in range(40)], "queue_id long, source_url string, entities array<string>")
    got = combined(queue, extracts).orderBy("dataset_id", "_ord").collect()
    for d in (0, 1):
        mine = [r for r in got if r["dataset_id"] == d]
        assert [r["_ord"] for r in mine] == list(range(len(mine)))
        assert [r["doc"].split(',"k":')[0] for r in mine] == [f'{{"_source":"u{k}","i":{i}' for k in range(40) if k % 2 == d for i in range(k % 4)]


def test_scratch_needs_a_shared_folder(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://there:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, other: None)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        fresh(Elsewhere())


@pytest.mark.parametrize("missing", ["weftline.llm", "weftline.llm.queries", "public_tokenizers", "corpus_pipeline"])
def test_entry_without_an_optional_module(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print('q_flagship' in q, 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False", "True"], out.stderr
