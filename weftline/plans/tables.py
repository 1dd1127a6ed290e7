"""Inputs of the registered queries: the driver's tables, and tables derived from them by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name -> (table, expressions): the catalogue, from tables that have other meanings.
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "datasets": (
        "customer",
        (
            "c_custkey AS dataset_id", "concat('u', CAST(c_nationkey AS STRING)) AS user_id", "c_name AS data_name",
            "CASE WHEN c_custkey % 5 = 0 THEN '  ' WHEN c_custkey % 3 = 0 THEN concat('alias ', c_name) END AS alias",
            "CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment END AS description", "c_mktsegment AS tag", "c_custkey % 11 = 0 AS is_premium", "c_acctbal AS price",
            "CAST(c_custkey % 17 AS BIGINT) AS clone_count", "CAST(c_custkey % 101 AS BIGINT) AS api_hit_count",
            "CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 99 ELSE 1 + c_custkey % 3 END AS INT) AS active_version",
            "CAST(concat('2024-', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')) AS TIMESTAMP) AS created_at",
            "CASE WHEN c_custkey % 2 = 0 THEN 'public' ELSE 'private' END AS visibility", "c_custkey % 23 = 0 AS is_frozen", "c_custkey % 4 = 0 AS nightly",
            "CASE WHEN c_custkey % 29 = 0 THEN 'amazon' ELSE 'web' END AS dataset_type",
        ),
    ),
    "versions": (
        "orders",
        (
            "o_custkey AS dataset_id", "CAST(1 + o_orderkey % 5 AS INT) AS version_number", "concat('f', CAST(o_orderkey AS STRING)) AS file_path",
            "CASE WHEN o_orderkey % 4 = 0 THEN concat('alt-f', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 4 = 1 THEN '' END AS alt_file_path",
            "CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE floor(o_totalprice) END AS BIGINT) AS entity_count", "o_orderdate AS created_at", "o_orderkey % 5 = 0 AS is_active",
        ),
    ),
    "files": ("orders", ("concat('f', CAST(o_orderkey AS STRING)) AS file_path", "CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey * 3 + 100 AS BIGINT) END AS bytes")),
    "schemas": ("customer", ("c_custkey AS dataset_id", "CASE WHEN c_custkey % 31 = 0 THEN 'reddit' ELSE 'serp' END AS source")),
    "subreddits": ("nation", ("CAST(n_nationkey * 37 + 1 AS BIGINT) AS dataset_id", "n_name AS subreddit")),
    "urls": (
        "part",
        (
            "p_partkey AS dataset_url_id", "CAST(1 + p_partkey % 700 AS BIGINT) AS dataset_id", "concat('http://', lower(p_brand), '.com/', CAST(p_partkey % 97 AS STRING)) AS url",
            "CASE WHEN p_partkey % 3 = 0 THEN 'serp' ELSE 'import' END AS source_type", "CASE WHEN p_partkey % 5 = 0 THEN 'discovery' ELSE 'extraction' END AS url_type",
        ),
    ),
    "queue": (
        "lineitem",
        (
            "CAST(l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS BIGINT) AS queue_id", "l_partkey AS dataset_url_id", "CAST(1 + l_partkey % 700 AS BIGINT) AS dataset_id",
            "CASE WHEN l_linestatus = 'O' AND l_orderkey % 9 = 0 THEN 'pending' WHEN l_orderkey % 8 = 0 THEN 'crawling' WHEN l_orderkey % 7 = 0 THEN 'proceed-format' WHEN l_orderkey % 5 = 0 THEN 'failed' ELSE 'done' END AS status",
            "CAST(l_linenumber % 4 AS INT) AS crawl_attempts", "CAST(l_linenumber + 2 AS INT) AS fail_count", "CASE WHEN l_orderkey % 3 = 0 THEN l_shipdate END AS locked_at", "l_shipdate AS created_at",
            "CASE WHEN l_suppkey % 4 = 0 THEN 'waiting' ELSE 'solo' END AS role",
        ),
    ),
    "reddit_queue": ("supplier", ("s_suppkey AS reddit_queue_id", "CAST(s_suppkey * 5 AS BIGINT) AS dataset_url_id", "CASE WHEN s_suppkey % 2 = 0 THEN 'pending' ELSE 'done' END AS status")),
    "users": (
        "nation",
        (
            "concat('u', CAST(n_nationkey AS STRING)) AS user_id", "n_name AS user_name", "CASE WHEN n_nationkey % 3 = 0 THEN 'free' ELSE 'starter' END AS plan",
            "CASE WHEN n_nationkey % 5 = 0 THEN 'free' END AS pending_plan", "CAST(concat('2024-', lpad(CAST(1 + n_nationkey % 12 AS STRING), 2, '0'), '-15') AS TIMESTAMP) AS plan_expires_at",
        ),
    ),
    "crawl": (
        "pages",
        ("page_id * 2 AS queue_id", "page_id AS dataset_url_id", "CAST(page_id % 7 AS BIGINT) AS dataset_id", "url", "concat('h', CAST(page_id % 3 AS STRING)) AS schema_hash", "'pending' AS status"),
    ),
    "recrawl": (
        "pages",
        (
            "page_id * 2 + 1 AS queue_id", "page_id + 1000000 AS dataset_url_id", "CAST(page_id % 5 AS BIGINT) AS dataset_id", "CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE concat(url, '/') END AS url",
            "concat('h', CAST(page_id % 3 AS STRING)) AS schema_hash", "'done' AS status",
        ),
    ),
}


def d(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    table, exprs = DERIVED[name]
    return t(spark, sf_dir, table).selectExpr(*exprs)


def sql(name: str) -> str:
    """A derived table for DuckDB, as a subquery."""
    table, exprs = DERIVED[name]
    return f"(SELECT {', '.join(exprs)} FROM {table})"


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS {sql(n)}" for n in names)


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items as an array, by line."""
    items = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_quantity"))).alias("items")
    )
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("state")).alias("buyer"))
    return orders.join(items, "o_orderkey").withColumn("_ord", F.col("o_orderkey"))


def edited_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and an edit of them: some rows gone, some with another status, some again under a new key."""
    v1 = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"))
    kept = v1.where("id % 17 <> 0").withColumn("status", F.when(F.col("id") % 13 == 0, "X").otherwise(F.col("status")))
    again = v1.where("id % 19 = 0").withColumn("id", F.col("id") + 100_000_000)
    return v1, kept.unionByName(again)


EDITED = """WITH v1 AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS cust FROM orders),
v2 AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'X' ELSE status END AS status, priority, cust FROM v1 WHERE id % 17 <> 0
  UNION ALL SELECT id + 100000000, status, priority, cust FROM v1 WHERE id % 19 = 0)"""
