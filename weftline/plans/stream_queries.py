"""Registered queries that run streams with state by key over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.urls import normal
from weftline.plans import catalog_queries, text_queries
from weftline.plans.tables import d, t
from weftline.sources.scratch import fresh
from weftline.streaming import keyed as K

COOL_S = 21_600
_ENGINE = "concat('e', CAST(user_id % 50 AS STRING))"
_MESSAGE = "CASE event_id % 7 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Blocked by owner' ELSE 'ok' END"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A stream takes a table of one file only by a pattern.
    return spark.readStream.schema(t(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _ran(stream: DataFrame, schema: str, made: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """What the stream's batches gave, through made() if given."""
    at = fresh(stream.sparkSession, "stream")
    K.write_batches(stream, f"{at}/rows", f"{at}/checkpoint", made, mode).awaitTermination()
    return K.batches(stream.sparkSession, f"{at}/rows", schema).drop("batch")


def w_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as requests to a bucket of two tokens a day."""
    out = _ran(K.granted(_stream(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", size=2, refill=86_400.0), "user_id bigint, event_id bigint, granted timestamp_ntz, waited double")
    return out.select("event_id", "granted", F.round("waited", 3).alias("waited"))


def w_cooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of fifty engines; after a refusal an engine rests for six hours."""
    calls = _stream(spark, sf_dir, "events").selectExpr("event_id AS call_id", f"{_ENGINE} AS engine", "ts", f"{_MESSAGE} AS message")
    return _ran(K.cooled(calls, seconds=COOL_S), "engine string, call_id bigint, skipped boolean").select("call_id", "skipped")


def t_boilerplate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = K.seen_sentences(_stream(spark, sf_dir, "documents"), "doc_id", "text")
    return _ran(stream, "id bigint, text string", K.whole_texts, "update").withColumnRenamed("id", "doc_id")


def c_cluster_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of c_cluster, which come in three batches: later ones join the leaders of those before."""
    at = fresh(spark, "stream")
    rows = d(spark, sf_dir, "crawl").unionByName(d(spark, sf_dir, "recrawl").where("queue_id % 3 = 1")).select("queue_id", "dataset_url_id", "url")
    last = rows.agg(F.coalesce(F.max("queue_id"), F.lit(0))).scalar()
    for k in range(3):
        rows.where(F.floor(F.col("queue_id") * 3 / (last + 1)) == k).write.mode("append").parquet(f"{at}/queue")
        stream = K.led(spark.readStream.schema(rows.schema).parquet(f"{at}/queue"), normal(F.col("url")))
        K.write_batches(stream, f"{at}/roles", f"{at}/checkpoint", K.roles).awaitTermination()
    return K.latest_roles(K.batches(spark, f"{at}/roles", "place bigint, role string, primary bigint")).withColumnRenamed("place", "queue_id")


QUERIES = {"w_granted": w_granted, "w_cooled": w_cooled, "t_boilerplate_stream": t_boilerplate_stream, "c_cluster_stream": c_cluster_stream}

ORACLE_SQL = {
    "w_granted": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, t, t AS b, 1 AS used FROM e WHERE i = 1 UNION ALL
 SELECT e.event_id, e.user_id, e.i, e.t, CASE WHEN e.t > r.b + 86400000000 THEN e.t WHEN r.used >= 2 THEN r.b + 86400000000 ELSE r.b END, CASE WHEN e.t > r.b + 86400000000 OR r.used >= 2 THEN 1 ELSE r.used + 1 END
 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, make_timestamp(greatest(t, b)) AS granted, round((greatest(t, b) - t) / 1e6, 3) AS waited FROM r""",
    "w_cooled": f"""WITH RECURSIVE e AS (SELECT event_id, user_id % 50 AS g, epoch_us(ts) AS t, event_id % 7 IN (0, 1) AS refused, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, g, i, false AS skipped, CASE WHEN refused THEN t + {COOL_S}000000 ELSE t - 1 END AS until FROM e WHERE i = 1 UNION ALL
 SELECT e.event_id, e.g, e.i, e.t <= r.until, CASE WHEN e.t <= r.until THEN r.until WHEN e.refused THEN e.t + {COOL_S}000000 ELSE e.t - 1 END FROM r JOIN e ON e.g = r.g AND e.i = r.i + 1)
SELECT event_id AS call_id, skipped FROM r""",
    "t_boilerplate_stream": text_queries.ORACLE_SQL["t_boilerplate_xdoc"],
    "c_cluster_stream": catalog_queries.ORACLE_SQL["c_cluster"],
}
