"""Streams with state by key: token buckets, cool-downs, sentences that many documents share, and clusters of work as it arrives.

Batches must come in order, as files do that are named or written in order; inside a batch rows are put in order here. What a batch brings is
handed on in the same batch, and write_batches() writes it under the batch's number, so that a batch which is run again after a lost machine
replaces what it wrote. A key that a large part of all rows shares reaches its state as a few rows of each task's frame, never as all its rows;
the rows themselves go past it, and meet what it says in a join. Only limiters take all of a key's requests: which one is let through depends on all before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weftline.functions.scalars import let
from weftline.functions.text import REPEATS, normal_sentence, sentences
from weftline.sources.scratch import fresh

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- running -----------------------------------------------------------------------------------------------------


def write_batches(stream: DataFrame, path: str, checkpoint: str, made: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> StreamingQuery:
    """Starts a query that writes what is there and stops: each batch, through made() if given, as Parquet in path/batch=N.

    A batch that is run again overwrites its own folder, so each row is there once. Keyed state needs the RocksDB store: the session's
    setting is changed for the start only.
    """

    def write(batch: DataFrame, number: int) -> None:
        (made(batch) if made else batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_batches() has written, with the number of the batch."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


def _once(batch: DataFrame) -> DataFrame:
    """batch as a written table, for those that read it more than once: the state must be asked once."""
    path = fresh(batch.sparkSession, "batch")
    batch.write.option("compression", "zstd").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c))


# --- limiters ----------------------------------------------------------------------------------------------------


class _ByTime(StatefulProcessor):
    """A key's rows (u, id) in order of time through step(); what it holds is dropped once the watermark is past its end.

    step(held, row) -> (held, out); held is (begin, used, until) or None. Rows that come later than the watermark allows are not seen, so
    what is dropped would have begun anew with any row that can still come.
    """

    def __init__(self, step: Callable[[tuple | None, Row], tuple[tuple, tuple]], names: list[str]):
        self.step, self.out = step, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "begin bigint, used int, until bigint, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        saved = self.held.get()
        held = tuple(saved[:3]) if saved else None
        for row in sorted(rows, key=lambda r: (r["u"], r["id"])):
            held, out = self.step(held, row)
            yield self.out(*key, row["id"], *out)
        if saved:
            self.handle.deleteTimer(saved[3])
        timer = held[2] // 1000 + 1
        self.held.update((*held, timer))
        self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())


def _by_time(rows: DataFrame, key: str, ts: str, number: str, delay: str, step: Callable, out: str) -> DataFrame:
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, number)}
    known = rows.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    names = [key, number, *(c.split()[0] for c in out.split(", "))]
    return known.withColumn("u", _micros(ts)).withColumn("id", F.col(number)).groupBy(key).transformWithState(
        _ByTime(step, names), f"`{key}` {kinds[key]}, `{number}` {kinds[number]}, {out}", "append", "EventTime"
    )


def granted(requests: DataFrame, key: str, ts: str, number: str, size: int = 55, refill: float = 60.0, delay: str = "1 hour") -> DataFrame:
    """(key, number, granted timestamp, waited double) of a stream of requests: when each gets its token of its key's bucket.

    A bucket's minute begins with the first request after the last one's end; then all `size` tokens are there again. A request that finds none
    waits for the end, in order of time and number. Requests without a time are left out; waiting ones keep the bucket's minutes without a gap.
    """
    span = round(refill * 1e6)

    def step(held: tuple | None, row: Row) -> tuple[tuple, tuple]:
        t = row["u"]
        begin, used, until = held or (t, 0, t + span)
        if t > until:
            begin, used = t, 0
        elif used >= size:
            begin, used = until, 0
        at = max(t, begin)
        return (begin, used + 1, begin + span), (at, (at - t) / 1e6)

    out = _by_time(requests.select(key, ts, number), key, ts, number, delay, step, "granted bigint, waited double")
    return out.withColumn("granted", F.timestamp_micros("granted").cast(requests.schema[ts].dataType))


def cooled(calls: DataFrame, engine: str = "engine", ts: str = "ts", number: str = "call_id", message: str = "message", seconds: int = 45, delay: str = "1 hour") -> DataFrame:
    """(engine, number, skipped boolean) of a stream of calls: a call within `seconds` of a refusal (429, or blocked) is not made, so its message counts for nothing."""
    span = seconds * 1_000_000
    refused = F.coalesce(F.col(message).contains("429") | F.lower(message).contains("blocked"), F.lit(False))

    def step(held: tuple | None, row: Row) -> tuple[tuple, tuple]:
        t, id_ = row["u"], held[2] if held else None
        if id_ is not None and t <= id_:
            return held, (True,)
        # Nothing to hold without a refusal: an end that is past at once.
        return (t, 1, t + span if row["refused"] else t - 1), (False,)

    return _by_time(calls.select(engine, ts, number, refused.alias("refused")), engine, ts, number, delay, step, "skipped boolean")


# --- sentences ---------------------------------------------------------------------------------------------------


def _sentence_key(c: Column) -> Column:
    """What a sentence is known by: the MD5 of its normal form; null if that is too short to go."""
    return let(normal_sentence(c), lambda n: F.when(F.octet_length(n) > 20, F.unhex(F.md5(n.cast("binary")))))


def seen_sentences(docs: DataFrame, number: str, text: str, most: int = REPEATS) -> DataFrame:
    """(id, text, k, total) of a stream of documents: the documents (k is null), and of sentences of a batch how often they have come by then, if `most` times or more.

    For write_batches(mode="update") and whole_texts(). Totals are Spark's own streaming aggregation: counted in each task before they are shuffled, so a
    sentence of all documents costs a row a task, and held by the MD5 of a sentence. (A processor in Python costs some 0.3 ms a sentence,
    and most sentences occur once.) Nothing is forgotten: a later document must find what all before it said.
    """
    whole = docs.select(F.col(number).alias("id"), F.col(text).alias("text"))
    totals = whole.select(F.explode(F.transform(sentences(F.col("text")), _sentence_key)).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("total")).where(F.col("total") >= most)
    own = whole.select("id", "text", F.lit(None).cast("binary").alias("k"), F.lit(None).cast("bigint").alias("total"))
    return own.unionByName(totals, allowMissingColumns=True)


def whole_texts(batch: DataFrame, most: int = REPEATS) -> DataFrame:
    """(id, text) of a batch of seen_sentences(): what is left of each document, its sentences joined by spaces; a text without sentences as it is.

    As drop_repeated_sentences(): a sentence of more than 20 bytes goes from the document on by which it has been seen `most` times (as seen_sentences() was
    told), in this batch and those before. Documents count in order of id, which is theirs alone and not null.
    """
    kept = _once(batch)
    docs, often = kept.where("k IS NULL").select("id", "text"), kept.where("k IS NOT NULL").select("k", "total")
    keys = docs.select("id", F.explode(F.transform(sentences(F.col("text")), _sentence_key)).alias("k")).join(often, "k")
    counted = _once(keys.groupBy("k", "total", "id").agg(F.count("*").alias("_c")))
    before = counted.groupBy("k").agg((F.max("total") - F.sum("_c")).alias("_before"))
    # With what came before, a sentence is full by its `most`-th document here at the latest; the limit is picked on either side of the shuffle.
    by_place = Window.partitionBy("k").orderBy("id")
    first = counted.withColumn("_r", F.row_number().over(by_place)).where(F.col("_r") <= most)
    first = first.withColumn("_seen", F.sum("_c").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(before, "k")
    since = first.where(F.col("_seen") + F.col("_before") >= most).groupBy("k").agg(F.min("id").alias("_since"))
    gone = counted.join(since, "k").where(F.col("id") >= F.col("_since")).groupBy("id").agg(F.collect_set("k").alias("_gone"))

    def left(own: Column) -> Column:
        stays = F.filter(own, lambda x: ~F.coalesce(F.array_contains("_gone", _sentence_key(x)), F.lit(False)))
        return F.when(F.size(own) == 0, F.col("text")).otherwise(F.array_join(F.when(F.col("_gone").isNull(), own).otherwise(stays), " "))

    return docs.join(gone, "id", "left").select("id", let(sentences(F.col("text")), left).alias("text"))


# --- clusters ----------------------------------------------------------------------------------------------------


_LED = Row("url_key", "place", "target", "before", "now")


class _Leaders(StatefulProcessor):
    """What is known of a key after a batch: its leader, and how many rows it had before and has now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leader = handle.getValueState("leader", "place long, target long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        heads = [(r["place"], r["target"], r["n"]) for r in rows]
        held = self.leader.get()
        place, target = held[:2] if held else min(h[:2] for h in heads)
        before = held[2] if held else 0
        now = before + sum(h[2] for h in heads)
        self.leader.update((place, target, now))
        yield _LED(key[0], place, target, before, now)


def led(queue: DataFrame, key: Column, place: str = "queue_id", target: str = "dataset_url_id") -> DataFrame:
    """(url_key, place, target, before, now) of a stream of work: its rows (before is null) and, of each key that the batch brings, the leader; for roles().

    The first row of a key leads; rows that come later, in this batch or another, join it. place and target are whole numbers, not null; rows
    of null keys share a leader. A key reaches its state as one row of each frame, however many rows ask for it.
    """
    rows = queue.select(F.coalesce(F.concat(F.lit("s"), key), F.lit("n")).alias("url_key"), F.col(place).cast("bigint").alias("place"), F.col(target).cast("bigint").alias("target"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = frame.groupby("url_key").size()
            heads = frame.sort_values(["place", "target"]).drop_duplicates("url_key")
            yield heads.assign(n=counts.loc[heads["url_key"]].to_numpy())

    leaders = rows.mapInPandas(run, "url_key string, place bigint, target bigint, n bigint").groupBy("url_key").transformWithState(
        _Leaders(), "url_key string, place bigint, target bigint, before bigint, now bigint", "append", "None"
    )
    return rows.select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("before", "now"))).unionByName(leaders)


def roles(batch: DataFrame) -> DataFrame:
    """(place, role, primary) of a batch of led(): of its rows, and of leaders that had been alone until now. As cluster() if rows come in order of place."""
    kept = _once(batch)
    leaders = kept.where("before IS NOT NULL").select("url_key", F.col("place").alias("_place"), F.col("target").alias("_target"), F.col("before").alias("_before"), F.col("now").alias("_now"))
    leads = (F.col("place") == F.col("_place")) & (F.col("target") == F.col("_target")) & (F.col("_before") == 0)
    role = F.when(~leads, "waiting").when(F.col("_now") == 1, "solo").otherwise("primary")
    own = kept.where("before IS NULL").join(leaders, "url_key").select("place", role.alias("role"), F.when(~leads, F.col("_target")).alias("primary"))
    raised = leaders.where("_before = 1 AND _now > 1").select(F.col("_place").alias("place"), F.lit("primary").alias("role"), F.lit(None).cast("bigint").alias("primary"))
    return own.unionByName(raised)


def latest_roles(rows: DataFrame) -> DataFrame:
    """(place, role, primary): the last word on each row of all batches (with column batch)."""
    return rows.groupBy("place").agg(F.max_by(F.struct("role", "primary"), "batch").alias("_r")).select("place", "_r.role", "_r.primary")
