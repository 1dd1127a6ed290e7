"""The entity query and the JSON operations: vectors derived by hand, and a slow model for random ones."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import jsonops
from weftline.functions.scalars import canonical, cell_text, number_str, number_text, slug, trim_u, value_text, word_count
from weftline.operators.query import QuerySpec, compile_json, compile_typed, page


def ask(spark, entities, **spec):
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(entities)], "_ord long, doc string")
    out = compile_json(QuerySpec(**spec), df)
    return [r["count"] for r in out.collect()] if "count" in out.columns else [json.loads(r["doc"]) for r in out.collect()]


@pytest.mark.parametrize(("x", "text", "plain", "cell"), [
    (5.0, "5", "5", "5"), (5.5, "5.5", "5.5", "5.5"), (999999.0, "999999", "999999", "999999"), (1e6, "1e+06", "1000000", "1000000"), (1234567.5, "1.2345675e+06", "1234567.5", "1.2345675e+06"),
    (1e-5, "1e-05", "0.00001", "1e-05"), (1e-7, "1e-07", "1e-7", "1e-07"), (0.0, "0", "0", "0"), (-2.5, "-2.5", "-2.5", "-2.5"), (1e21, "1e+21", "1e+21", "1e+21"), (3.25, "3.25", "3.25", "3.25"),
])
def test_number_forms(x, text, plain, cell):
    assert (number_text(x), canonical(x), cell_text(x)) == (text, plain, cell)


def test_number_column_is_the_python_form(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 14) for _ in range(300)] + [0.0, 1.0, 1e5, 1e6, 1e7, 1e-3, 1e-4, 1e-5, float("inf"), float("nan"), 123456.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", number_str(F.col("x")).alias("s")).collect()
    assert all(r["s"] == number_text(r["x"]) for r in got)


def test_value_forms():
    assert value_text(None) == "<nil>" and value_text([1.0, "a", None]) == "[1 a <nil>]" and value_text({"b": True, "a": 1e6}) == "map[a:1e+06 b:true]"
    assert canonical({"b": "<é>&", "a": [1.0, None]}) == '{"a":[1,null],"b":"\\u003cé\\u003e\\u0026"}'


@pytest.mark.parametrize(("op", "arg", "entity", "want"), [
    ("denull", None, {"a": None, "b": " ", "c": {"d": None}, "e": [None, ""], "f": [{"g": None}], "h": 0.0}, {"c": {}, "f": [{}], "h": 0.0}),
    ("keep", ["title", "reviews.rating"], {"title": "T", "x": 1, "reviews": [{"rating": 5, "a": 1}, {"a": 2}]}, {"title": "T", "reviews": [{"rating": 5}, {}]}),
    ("keep", ["a.b"], {"a": 7}, {"a": 7}), ("keep", ["t"], {"t": None}, {}), ("keep", ["a", "a.b"], {"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 2}}),
    ("drop", ["reviews.a"], {"title": "T", "x": 1, "reviews": [{"rating": 5, "a": 1}, {"a": 2}]}, {"title": "T", "x": 1, "reviews": [{"rating": 5}, {}]}),
    ("drop", ["a.b"], {"a": None, "c": 1}, {"c": 1}), ("drop", ["a"], {"a": {"b": 1}}, {}),
])
def test_projections(op, arg, entity, want):
    assert (jsonops.denull(entity) if arg is None else getattr(jsonops, op)(entity, jsonops.trie(arg))) == want


def test_paths_and_flattening():
    assert jsonops.values_at({"r": [{"x": 1}, {"x": [2, 3]}, {"y": 4}]}, "r.x") == [1, [2, 3]]
    assert jsonops.values_at([[{"a": {"b": 1}}], {"a": [{"b": 2}]}], "a.b") == [1, 2]
    assert jsonops.flatten({"a": {"b": 1.0, "c": {}}, "t": ["x", "y"], "e": [], "r": [{"k": 1.0}, 2.0]}) == {"a_b": 1.0, "t": '["x","y"]', "e": "[]", "r_0_k": 1.0, "r_1": 2.0}
    assert jsonops.flatten({"_source": "s", "a": [{"_source": "t", "b": 1.0}]}, "_source") == {"a_0_b": 1.0}


def test_filters(spark):
    rows = [{"n": 5.0}, {"n": 1000000}, {"n": None}, {}, {"n": "Five"}]
    assert ask(spark, rows, filters=(("n", "5"),)) == [{"n": 5}]
    assert ask(spark, rows, filters=(("n", "1000000"),)) == [] and ask(spark, rows, filters=(("n", "1e+06"),)) == [{"n": 1000000}]
    assert ask(spark, rows, filters=(("n", "<nil>"),)) == [{"n": None}] and ask(spark, rows, contains=(("n", "iv"),)) == [{"n": "Five"}]
    assert ask(spark, [{"a": "x", "b": 1}], keep=("a",), filters=(("b", "1"),)) == []


def test_keywords_order_and_dedup(spark):
    rows = [{"v": "abc"}, {"v": 10}, {"v": 9}, {"w": 1}]
    assert ask(spark, rows, sort="v") == [{"v": 9}, {"v": 10}, {"w": 1}, {"v": "abc"}]
    assert ask(spark, rows, keywords=("AB", "9")) == [{"v": "abc"}, {"v": 9}] and ask(spark, rows, keywords=("ab", "9"), keywords_mode="and") == []
    assert ask(spark, rows, keywords=("v",)) == []
    twice = [{"a": 1, "_source": "s1"}, {"a": 1.0, "_source": "s2"}, {"a": 2}]
    assert ask(spark, twice, dedup=True) == [twice[0], twice[2]]
    assert ask(spark, [{"k": None}, {}, {"k": 1}], dedup_key=("k",)) == [{"k": None}, {"k": 1}]


def test_paging(spark):
    rows = [{"i": i} for i in range(10)]
    assert ask(spark, rows, limit=3, count=True) == [3] and ask(spark, rows, offset=8) == rows[8:] and ask(spark, rows, offset=10) == []
    assert len(ask(spark, rows, sample=4, seed=1)) == 4 and len(ask(spark, rows, sample=40)) == 10
    df = spark.range(101).select(F.col("id").alias("_ord"))
    got = page(df, 2).collect()
    assert [(r["_ord"], r["total"], r["total_pages"]) for r in got] == [(100, 101, 2)] and page(df, 1, 9999).count() == 101


def test_flatten_first(spark):
    rows = [{"a": {"b": 1}}]
    assert ask(spark, rows, flatten_first=True, filters=(("a.b", "1"),)) == [] and ask(spark, rows, flatten_first=True, filters=(("a_b", "1"),)) == [{"a_b": 1}]
    assert ask(spark, rows, flatten=True) == [{"a_b": 1}]


def test_what_is_no_object_is_left_out(spark):
    df = spark.createDataFrame([(0, "[1]"), (1, "7"), (2, None), (3, "{"), (4, '{"a":1}')], "_ord long, doc string")
    assert [r["_ord"] for r in compile_json(QuerySpec(), df).collect()] == [4]


def test_parameters():
    s = QuerySpec.parse({"filter": ["a: X ", "bad", "b:c:d"], "sort": "v:desc", "limit": "x", "offset": "-1", "keywords": "A, b,", "dedup_key": "k", "include_source": "false"})
    assert s.filters == (("a", "x"), ("b", "c:d")) and s.sort == "v" and s.descending and s.limit == 0 and s.offset == 0 and s.keywords == ("a", "b") and s.dedup and not s.include_source


values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5).map(float) | st.sampled_from(["", " ", "a", "Ab"]), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from("abc"), c, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abc"), values, max_size=3), st.lists(st.sampled_from(["a", "b", "a.b", "a.b.c", "c.a"]), min_size=1, max_size=2))
def test_json_operations_hold_together(entity, paths):
    tree = jsonops.trie(paths)
    assert jsonops.denull(jsonops.denull(entity)) == jsonops.denull(entity)
    assert jsonops.keep(jsonops.keep(entity, tree), tree) == jsonops.keep(entity, tree)
    assert not any(x is not None for p in paths for x in jsonops.values_at(jsonops.drop(entity, tree), p))
    assert json.loads(canonical(entity), parse_int=float) == entity
    assert not any(isinstance(v, dict) for v in jsonops.flatten(entity).values())


def test_typed_and_json_plans_agree(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("xyz"), rng.choice([None, "Ann", "bob", "5", "10"]), rng.choice([1.0, 2.5, 1e6]), [(rng.choice("pq"), rng.randint(0, 3)) for _ in range(rng.randint(0, 3))]) for i in range(120)]
    df = spark.createDataFrame(rows, "_ord long, k string, name string, price double, items array<struct<c: string, n: int>>")
    docs = df.select("_ord", F.to_json(F.struct("k", "name", "price", "items")).alias("doc"))
    for spec in (QuerySpec(filters=(("items.c", "p"),), contains=(("name", "n"),)), QuerySpec(sort="name", limit=30), QuerySpec(dedup_key=("k", "name"), sort="price", descending=True), QuerySpec(keywords=("ann", "1e+06"), keywords_mode="and"), QuerySpec(filters=(("price", "1e+06"),), offset=3, limit=9)):
        assert [r["_ord"] for r in compile_typed(spec, df).collect()] == [r["_ord"] for r in compile_json(spec, docs).collect()], spec


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i % 3}", i) for i in range(9)], "id long, name string, other long").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").withColumn("_ord", F.col("id"))
    plan = compile_typed(QuerySpec(keep=("name",), filters=(("name", "n1"),)), df)._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_string_helpers(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("r")).first()[0]
    assert one(trim_u, "   x\x0b ") == "x" and one(word_count, " a b  c ") == 3 and one(slug, "My  Data_Set!") == "my-data-set"
