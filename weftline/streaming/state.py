"""Stateful operators: rate limits, cool-downs, the work queue's tick and sinks that are told of new versions.

A limiter's window begins with a key's first request, so it is no window of the clock; a key's state is one small row.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from weftline.sources.publish import Published
from weftline.sources.scratch import fresh, numbered

WINDOW_S, PUBLIC, PRIVATE = 60.0, 100, 300
LIMITED = "allowed boolean, remaining int, retry_after double"
STATE = "start double, used int"
#: Requests of a key that one task reads in order.
BUSY = 1 << 20
_NEXT_NAMES = ["k", "u", "to", "piece", "head"]


def admit(times: Iterable[float], limit: int, window: float = WINDOW_S, start: float | None = None, used: int = 0) -> Iterator[tuple[bool, int, float, float, int]]:
    """(allowed, remaining, retry_after, start, used) of requests in order of time."""
    for t in times:
        if start is None or t - start > window:
            start, used = t, 0
        if used >= limit:
            yield False, 0, window - (t - start), start, used
        else:
            used += 1
            yield True, limit - used, 0.0, start, used


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int = PUBLIC, window: float = WINDOW_S, most: int = BUSY) -> DataFrame:
    """events with allowed, remaining, retry_after. A key's requests are read in order of ts and order; times count in microseconds.

    Keys of at most `most` requests are dealt out over partitions and sorted there; a partition is read as a stream that
    holds the state of one key. Busier keys are spread over tasks: see _busy().
    """
    path = fresh(events.sparkSession, "busy")
    events.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_k").write.parquet(path)
    busy = events.sparkSession.read.schema(StructType([StructField("_k", events.schema[key].dataType)])).parquet(path)
    if busy.isEmpty():
        return _in_order(events, key, ts, order, limit, window)
    same = F.col(key).eqNullSafe(F.col("_k"))
    return _in_order(events.join(busy, same, "left_anti"), key, ts, order, limit, window).unionByName(_busy(events.join(busy, same, "left_semi"), key, ts, order, limit, window))


def _in_order(events: DataFrame, key: str, ts: str, order: str, limit: int, window: float) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields), LIMITED])
    names, span = events.columns, round(window * 1e6)
    sorted_rows = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, ts, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start, used = None, None, 0
        for batch in batches:
            keys, times = batch.column(names.index(key)).to_pylist(), batch.column(len(names)).to_pylist()
            out: list[tuple[bool, int, float]] = []
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if held != (keys[i],):
                    held, start, used = (keys[i],), None, 0
                for allowed, remaining, retry, start, used in admit(times[i:j], limit, span, start, used):  # noqa: B020
                    out.append((allowed, remaining, retry / 1e6))
                i = j
            made = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.bool_(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, "allowed", "remaining", "retry_after"])

    return sorted_rows.mapInArrow(run, schema)


def _following(points: DataFrame, span: int) -> DataFrame:
    """(k, u, to): of each distinct time of a key the first one that is more than span later; those that have one.

    Times and what they ask for are sorted together, in pieces; a piece answers by itself but for what stands behind its last time,
    and that is the first time of a piece that follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        table = pa.Table.from_batches(rows)
        group = np.cumsum(np.r_[0, [a != b for a, b in pairwise(table["k"].to_pylist())]])
        x, asks = table["x"].to_numpy(), table["asks"].to_numpy()
        times = np.flatnonzero(~asks)
        at = np.flatnonzero(asks)
        to = np.searchsorted(times, at)
        inside = to < len(times)
        place = times[np.minimum(to, max(len(times) - 1, 0))] if len(times) else np.zeros(len(at), np.int64)
        # Answered: by a time of the key, or, as the next time is another key's, by none.
        good = inside & (group[place] == group[at])
        piece = TaskContext.get().partitionId()
        keep = np.flatnonzero(good | ~inside)
        found = pa.array(x[place[keep]], mask=~good[keep])
        first = times[:1]
        parts = [
            pa.RecordBatch.from_arrays([table["k"].combine_chunks().take(pa.array(at[keep])), pa.array(x[at[keep]] - span), found, pa.array(np.full(len(keep), piece)), pa.array(np.zeros(len(keep), bool))], names=_NEXT_NAMES),
            pa.RecordBatch.from_arrays([table["k"].combine_chunks().take(pa.array(first)), pa.array(x[first]), pa.array(x[first]), pa.array(np.full(len(first), piece)), pa.array(np.ones(len(first), bool))], names=_NEXT_NAMES),
        ]
        yield from parts

    kind = points.schema["k"].dataType.simpleString()
    both = points.select("k", F.col("u").alias("x"), F.lit(False).alias("asks")).unionByName(points.select("k", (F.col("u") + span).alias("x"), F.lit(True).alias("asks")))
    path = fresh(points.sparkSession, "following")
    schema = f"k {kind}, u bigint, to bigint, piece bigint, head boolean"
    both.repartitionByRange("k", "x", "asks").sortWithinPartitions("k", "x", "asks").mapInArrow(run, schema).write.parquet(path)
    made = points.sparkSession.read.schema(schema).parquet(path)
    answered = made.where("NOT head AND to IS NOT NULL").select("k", "u", "to")
    # One row a piece. What a piece leaves open goes to the first piece after it that has a time.
    heads = made.where("head").select(F.col("k").alias("_k"), F.col("to").alias("_to"), F.col("piece").alias("_piece"))
    open_ = made.where("NOT head AND to IS NULL").select("k", "u", "piece")
    after = open_.select("piece").distinct().join(heads.select("_piece"), F.col("_piece") > F.col("piece")).groupBy("piece").agg(F.min("_piece").alias("_piece"))
    late = open_.join(after, "piece").join(heads, "_piece").where(F.col("k").eqNullSafe(F.col("_k"))).select("k", "u", F.col("_to").alias("to"))
    return answered.unionByName(late)


def _busy(events: DataFrame, key: str, ts: str, order: str, limit: int, window: float) -> DataFrame:
    """rate_limit() of keys that are too busy for a task.

    Each time of a key points to the first one beyond a window that would begin there. Windows begin at the key's first time and at all that it leads
    to; doubled pointers find them in as many rounds as the count of windows has binary digits, by joins on (key, time). Two windows of a key begin more than a
    window apart, so in a grid of that width a request's window begins in its own cell or the one before. What remains is a place less another one.
    """
    span, spark = round(window * 1e6), events.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = fresh(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = events.withColumn("_k", F.struct(key)).withColumn("_u", F.unix_micros(F.col(ts).cast("timestamp")))
    placed = kept(numbered(rows, [F.col(key), F.col(ts), F.col(order)], "_p"), "requests")
    points = kept(placed.groupBy(F.to_json("_k").alias("k"), F.col("_u").alias("u")).agg(F.min("_p").alias("p")), "times")
    jump = kept(_following(points, span), "pointers")
    begins = kept(points.groupBy("k").agg(F.min("u").alias("u")), "begins")
    while not jump.isEmpty():
        begins = kept(begins.unionByName(begins.join(jump, ["k", "u"]).select("k", F.col("to").alias("u"))).distinct(), "begins")
        jump = kept(jump.join(jump.select("k", F.col("u").alias("to"), F.col("to").alias("_to")), ["k", "to"]).select("k", "u", F.col("_to").alias("to")), "pointers")
    cell = F.floor(F.col("u") / F.lit(span))
    begins = kept(begins.join(points, ["k", "u"]).select("k", cell.alias("cell"), F.struct("u", "p").alias("b")), "windows")
    own, before = (begins.select(F.col("k").alias("_key"), (F.col("cell") + i).alias("_cell"), F.col("b").alias(f"_b{i}")) for i in (0, 1))
    found = placed.withColumn("_key", F.to_json("_k")).withColumn("_cell", F.floor(F.col("_u") / F.lit(span))).join(own, ["_key", "_cell"], "left").join(before, ["_key", "_cell"], "left")
    begin = F.when(F.col("_b0.u") <= F.col("_u"), F.col("_b0")).otherwise(F.col("_b1"))
    nth = F.col("_p") - F.col("_b.p")
    return found.withColumn("_b", begin).select(
        *events.columns, (nth < limit).alias("allowed"), F.greatest(limit - 1 - nth, F.lit(0)).cast("int").alias("remaining"),
        F.when(nth < limit, F.lit(0.0)).otherwise((span - (F.col("_u") - F.col("_b.u"))) / 1e6).alias("retry_after"),
    )


def rate_limit_stream(events: DataFrame, key: str, ts: str, limit: int = PUBLIC, window: float = WINDOW_S) -> DataFrame:
    """rate_limit() of a stream of (key, ts): the state of a key is (start, used), dropped an hour after its last request."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        frame = pd.concat(list(frames)).sort_values(ts) if not state.hasTimedOut else None
        if frame is None:
            state.remove()
            return
        got = list(admit((x.timestamp() for x in frame[ts]), limit, window, start, used))
        if got:
            state.update(got[-1][3:])
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({key: k[0], ts: frame[ts].to_list(), "allowed": [g[0] for g in got], "remaining": [g[1] for g in got], "retry_after": [g[2] for g in got]})

    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` timestamp, {LIMITED}", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


class TokenBucket:
    """All tokens come back a minute after the first was taken."""

    def __init__(self, size: int = 55, refill: float = 60.0, now: Callable[[], float] = time.monotonic):
        self.size, self.refill, self.now = size, refill, now
        self.left, self.since = size, now()

    def wait(self) -> float:
        """Takes a token; seconds to wait for it, 0 if there was one."""
        if self.now() - self.since >= self.refill:
            self.left, self.since = self.size, self.now()
        if self.left:
            self.left -= 1
            return 0.0
        return self.refill - (self.now() - self.since)


def cooling(calls: DataFrame, as_of: Column, seconds: int = 45) -> DataFrame:
    """(engine, cooling): whether an engine's last refusal (429, or blocked) is too recent. calls: (engine, ts, message)."""
    refused = F.col("message").contains("429") | F.lower("message").contains("blocked")
    return calls.groupBy("engine").agg(F.max(F.when(refused, F.col("ts"))).alias("_t")).select("engine", F.coalesce(F.col("_t") > as_of - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False)).alias("cooling"))


def per_domain(urls: DataFrame, domain: Column, fetch: Callable[[str], str], partitions: int) -> DataFrame:
    """(url, result): one fetch at a time for each domain, domains side by side. A failure is an empty result."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for u in frame["url"]:
                try:
                    out.append(fetch(u))
                except Exception:  # a page that can't be fetched is no reason to stop the others
                    out.append("")
            yield pd.DataFrame({"url": frame["url"], "result": out})

    return urls.withColumn("_d", domain).repartition(partitions, "_d").select("url").mapInPandas(run, "url string, result string")


#: What follows each stage of a row's work, by its dataset's type.
NEXT = {
    "web": {"crawling": "proceed-clean", "proceed-clean": "proceed-format", "proceed-format": "proceed-extract", "proceed-extract": "proceed-version", "proceed-version": "done"},
    "amazon": {"crawling": "proceed-format", "proceed-format": "proceed-version", "proceed-version": "done"},
    "reddit": {"pending": "proceed-combine", "proceed-combine": "proceed-version", "proceed-version": "done"},
}


def advanced(queue: DataFrame, finished: DataFrame) -> DataFrame:
    """queue with rows of finished (queue_id, ok) a stage on, or failed."""
    steps = F.create_map(*(F.lit(x) for kind, stages in NEXT.items() for a, b in stages.items() for x in (f"{kind}/{a}", b)))
    rows = queue.join(finished, "queue_id", "left")
    after = F.coalesce(F.try_element_at(steps, F.concat_ws("/", F.coalesce("kind", F.lit("web")), "status")), F.col("status"))
    return rows.withColumn("status", F.when(F.col("ok"), after).when(~F.col("ok"), "failed").otherwise(F.col("status"))).select(*queue.columns)


def ticked(root: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A tick for run_ticks(): publishes step(the queue, the batch) as the next version of the queue at root, once for each batch.

    The ledger of batches is in the versions' names, so a version and its entry are published as one: a batch that
    is run again after a restart finds its number there and changes nothing, and of two runs side by side one is late.
    """

    def tick(batch: DataFrame, batch_id: int) -> None:
        queue = Published(batch.sparkSession, root)
        read = queue.current()
        known = re.match(r"b(\d+)-", read or "")
        if known and int(known[1]) >= batch_id:
            return
        queue.publish(queue.write(step(queue.read(read), batch), f"b{batch_id}-"), read)

    return tick


def stepped(queue: DataFrame, results: DataFrame) -> DataFrame:
    """advanced() by results (queue_id, ok) of rows that are open; results of others are left out."""
    open_ = queue.where("status NOT IN ('done', 'failed')").select("queue_id")
    return advanced(queue, results.select("queue_id", "ok").join(open_, "queue_id", "left_semi"))


def run_ticks(stream: DataFrame, tick: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each batch of new rows to tick, all that are there and then stops; batches are never handed out side by side."""
    return stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signed(payload: dict, secret: str) -> tuple[str, str]:
    """A message's body and its signature."""
    body = json.dumps(payload, sort_keys=True)
    return body, hmac.new(secret.encode(), body.encode(), hashlib.sha512).hexdigest()


def deliver(events: DataFrame, send: Callable[[str, str], int], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, status, tries) of events (url, body): each is sent until a success, three times at most, two seconds more apart each time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, body in zip(frame["url"], frame["body"], strict=True):
                status, n = 0, 0
                while n < tries and not 200 <= status < 300:
                    if n:
                        pause(2.0 * n)
                    n += 1
                    try:
                        status = send(url, body)
                    except OSError:
                        status = 0
                rows.append((url, status, n))
            yield pd.DataFrame(rows, columns=["url", "status", "tries"])

    return events.select("url", "body").mapInPandas(run, "url string, status int, tries int")
