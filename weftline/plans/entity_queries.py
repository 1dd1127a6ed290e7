"""Registered queries over entities: filters, paths, projections, order, dedup, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.query import QuerySpec, compile_json, compile_typed, page
from weftline.plans.tables import nested_orders, t


def _rows(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return t(spark, sf_dir, name).withColumn("_ord", F.col(key))


def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest purchase of each user, the 50 dearest of those."""
    spec = QuerySpec(filters=(("event_type", "purchase"),), sort="value", descending=True, dedup_key=("user_id",), limit=50)
    return compile_typed(spec, _rows(spark, sf_dir, "events", "event_id")).drop("_ord")


def q_filter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec(filters=(("p_brand", "brand#13"), ("p_size", "7")))
    return compile_typed(spec, _rows(spark, sf_dir, "part", "p_partkey")).drop("_ord")


def q_filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec(contains=(("p_type", "a"), ("p_name", "e")), keep=("p_partkey", "p_name", "p_type"))
    return compile_typed(spec, _rows(spark, sf_dir, "part", "p_partkey")).drop("_ord")


def _keywords(mode: str, words: tuple[str, ...] = ("an", "1")):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = QuerySpec(keep=("n_nationkey", "n_name"), keywords=words, keywords_mode=mode)
        return compile_typed(spec, _rows(spark, sf_dir, "nation", "n_nationkey")).drop("_ord")

    return query


def q_path_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with any item that was returned."""
    spec = QuerySpec(filters=(("items.l_returnflag", "r"), ("buyer.state", "f")))
    return compile_typed(spec, nested_orders(spark, sf_dir)).select("o_orderkey", F.size("items").cast("bigint").alias("n_items"))


def q_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compile_typed(QuerySpec(keep=("o_orderkey", "items.l_partkey", "buyer.key")), nested_orders(spark, sf_dir))
    return out.select("o_orderkey", F.to_json("items").alias("items"), F.to_json("buyer").alias("buyer"))


def q_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compile_typed(QuerySpec(drop=("o_orderstatus", "items.l_quantity", "items.l_returnflag", "buyer.state")), nested_orders(spark, sf_dir))
    return out.select("o_orderkey", "o_orderpriority", F.to_json("items").alias("items"), F.to_json("buyer").alias("buyer"))


def q_denull(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "customer", "c_custkey").select(
        "_ord", "c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END").alias("name"),
        F.expr("array(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 4 = 0 THEN '' END)").alias("tags"),
    )
    return compile_typed(QuerySpec(denull=True), rows).select("c_custkey", "name", F.array_join("tags", ",").alias("tags"))


def q_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_typed(QuerySpec(keep=("o_orderkey", "buyer", "items.l_partkey"), flatten=True), nested_orders(spark, sf_dir)).drop("_ord")


def q_sort_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers before other texts; the first 200."""
    rows = _rows(spark, sf_dir, "part", "p_partkey").select("_ord", "p_partkey", F.expr("CASE WHEN p_partkey % 10 = 0 THEN CAST(p_size AS STRING) WHEN p_partkey % 10 = 1 THEN p_brand END").alias("v"))
    return compile_typed(QuerySpec(sort="v", offset=100, limit=300), rows).drop("_ord")


def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_typed(QuerySpec(keep=("p_name", "p_brand"), dedup=True), _rows(spark, sf_dir, "part", "p_partkey")).select(F.col("_ord").alias("p_partkey"), "p_name", "p_brand")


def q_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_typed(QuerySpec(dedup_key=("text",)), _rows(spark, sf_dir, "documents", "doc_id")).select("doc_id", "lang", "source")


def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").withColumn("_ord", F.col("c_custkey") - t(spark, sf_dir, "customer").agg(F.min("c_custkey")).scalar())
    return page(rows.select("_ord", "c_custkey", "c_name"), 2, 100).drop("_ord")


def q_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_typed(QuerySpec(filters=(("event_type", "click"),), offset=5, count=True), _rows(spark, sf_dir, "events", "event_id"))


def q_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_typed(QuerySpec(offset=40, limit=25), _rows(spark, sf_dir, "supplier", "s_suppkey")).drop("_ord")


def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_typed(QuerySpec(sample=100, seed=3), _rows(spark, sf_dir, "events", "event_id")).drop("_ord")


def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stages over entities as JSON text."""
    doc = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.lit("").alias("blank")).alias("kind"), F.lit("s").alias("_source")))
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ord"), doc.alias("doc"))
    spec = QuerySpec(include_source=False, denull=True, filters=(("kind.size", "7"),), drop=("kind.size",), dedup=True)
    # The order of stages is fixed: what is dropped can't be filtered by, so the filter is a query of its own.
    found = compile_json(QuerySpec(filters=spec.filters), rows)
    out = compile_json(QuerySpec(include_source=False, denull=True, drop=spec.drop, dedup=True), found)
    return out.select(F.col("_ord").alias("p_partkey"), "doc")


def q_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    rows = items.select(F.col("conv_id").alias("_ord"), F.to_json(F.struct(F.col("conv_id"), "turns")).alias("doc"))
    return compile_json(QuerySpec(contains=(("turns.role", "assist"),), flatten=True), rows).select(F.col("_ord").alias("conv_id"), "doc")


_NESTED = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_returnflag': l_returnflag, 'l_quantity': l_quantity} ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS items
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
_FIRST_BY = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {table}) WHERE rn = 1"

QUERIES = {
    "q_flagship": q_flagship, "q_filter_exact": q_filter_exact, "q_filter_contains": q_filter_contains, "q_keywords_or": _keywords("or"), "q_keywords_and": _keywords("and", ("nation", "1")),
    "q_path_fanout": q_path_fanout, "q_keep": q_keep, "q_drop": q_drop, "q_denull": q_denull, "q_flatten": q_flatten, "q_sort_mixed": q_sort_mixed, "q_dedup": q_dedup,
    "q_dedup_key": q_dedup_key, "q_page": q_page, "q_count": q_count, "q_offset_limit": q_offset_limit, "q_sample": q_sample, "q_json": q_json, "q_json_flatten": q_json_flatten,
}

ORACLE_SQL = {
    "q_flagship": "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1 ORDER BY value DESC, event_id LIMIT 50",
    "q_filter_exact": "SELECT * FROM part WHERE lower(p_brand) = 'brand#13' AND p_size = 7",
    "q_filter_contains": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_type), 'a') AND contains(lower(p_name), 'e')",
    "q_keywords_or": "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'an') OR contains(lower(n_name), '1') OR contains(CAST(n_nationkey AS VARCHAR), '1')",
    "q_keywords_and": "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation') AND (contains(lower(n_name), '1') OR contains(CAST(n_nationkey AS VARCHAR), '1'))",
    "q_sample": "SELECT * FROM events ORDER BY md5(concat('3:', event_id)), event_id LIMIT 100",
    "q_path_fanout": "SELECT o_orderkey, count(*) AS n_items FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE lower(o_orderstatus) = 'f' GROUP BY o_orderkey HAVING bool_or(l_returnflag = 'R')",
    "q_keep": _NESTED + " SELECT o_orderkey, CAST(to_json(list_transform(items, lambda x: {'l_partkey': x.l_partkey})) AS VARCHAR) AS items, CAST(to_json({'key': o_custkey}) AS VARCHAR) AS buyer FROM o",
    "q_drop": _NESTED + " SELECT o_orderkey, o_orderpriority, CAST(to_json(list_transform(items, lambda x: {'l_linenumber': x.l_linenumber, 'l_partkey': x.l_partkey})) AS VARCHAR) AS items, CAST(to_json({'key': o_custkey}) AS VARCHAR) AS buyer FROM o",
    "q_denull": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS tags FROM customer",
    "q_flatten": _NESTED + " SELECT o_orderkey, o_custkey AS buyer_key, o_orderstatus AS buyer_state, CAST(to_json(list_transform(items, lambda x: {'l_partkey': x.l_partkey})) AS VARCHAR) AS items FROM o",
    "q_sort_mixed": "SELECT p_partkey, v FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 10 = 1 THEN p_brand END AS v FROM part) ORDER BY TRY_CAST(v AS DOUBLE) NULLS LAST, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN coalesce(v, '<nil>') END, p_partkey LIMIT 300 OFFSET 100",
    "q_dedup": _FIRST_BY.format(cols="p_partkey, p_name, p_brand", by="p_name, p_brand", order="p_partkey", table="part"),
    "q_dedup_key": _FIRST_BY.format(cols="doc_id, lang, source", by="text", order="doc_id", table="documents"),
    "q_page": "SELECT c_custkey, c_name, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 100) AS BIGINT) AS total_pages FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 100",
    "q_count": "SELECT count(*) AS count FROM (SELECT 1 FROM events WHERE event_type = 'click' OFFSET 5)",
    "q_offset_limit": "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 25 OFFSET 40",
    "q_json": "SELECT p_partkey, concat('{\"kind\":{\"brand\":\"', p_brand, '\"},\"name\":\"', p_name, '\"}') AS doc FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_size = 7) WHERE rn = 1",
    "q_json_flatten": "SELECT conv_id, concat('{\"conv_id\":', conv_id, ',', string_agg(p, ',' ORDER BY k), '}') AS doc FROM (SELECT conv_id, concat('turns_', i, '_', f.n) AS k, concat('\"turns_', i, '_', f.n, '\":', f.v) AS p FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS i, bool_or(contains(role, 'assist')) OVER (PARTITION BY conv_id) AS hit FROM conversations), LATERAL (SELECT 'role' AS n, concat('\"', role, '\"') AS v UNION ALL SELECT 'turn', CAST(turn AS VARCHAR)) f WHERE hit) GROUP BY conv_id",
}
