"""A splittable scan of JSON version files: one document of any size is read by as many tasks as it has splits.

Spark's text source cuts a file at each closing brace and hands out byte ranges, so a split begins behind a brace: inside a string or not, at some depth.
A first pass tells, for either case, whether a split ends inside a string and how far it goes up or down; carried from split to split (one small row
each) that gives every split its beginning. A second pass cuts the members of `entities` and `posts` out, all splits side by side. A member ends at a brace, so it is
a run of pieces; one that goes on beyond its split is put together from its parts, and places follow from the counts of the splits before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.scratch import fresh

KEYS = ("entities", "posts")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{}]', re.S)
_CLOSE = re.compile(r'(?:[^"\\]|\\.)*', re.S)
_ESCAPED = re.compile(r"\\.", re.S)
_CUT = "path string, block bigint, part int, key string, place bigint, text string"
_CUT_NAMES = ["path", "block", "part", "key", "place", "text"]
#: Kinds of rows of the second pass: a whole member, a split's first part of one that began before (with its end or without), its last part of one that goes on, its last key.
WHOLE, END, MIDDLE, BEGIN, KEY = range(5)


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, odd, out, inside): of each split whether it holds an odd number of quotes, and how far it goes down if it begins outside a string or inside one."""
    at, odd, down = None, False, [0, 0]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([odd]), pa.array([down[0]]), pa.array([down[1]])], names=["path", "block", "odd", "out", "inside"])

    for batch in batches:
        for path, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, block) != at:
                if at:
                    yield out()
                at, odd, down = (path, block), False, [0, 0]
            for i, part in enumerate((_ESCAPED.sub("  ", text) + "}").split('"')):
                odd ^= i > 0
                down[odd] += part.count("{") + part.count("[") - part.count("}") - part.count("]")
    if at:
        yield out()


def _carried(splits: DataFrame) -> DataFrame:
    """(path, block, quoted, depth): the state in which each split begins. A file's splits are gathered, one small row each."""
    start = F.struct(F.array().cast("array<struct<block:bigint,quoted:boolean,depth:bigint>>").alias("a"), F.lit(False).alias("q"), F.lit(0).cast("bigint").alias("d"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["block"].alias("block"), acc["q"].alias("quoted"), acc["d"].alias("depth"))
        return F.struct(F.array_append(acc["a"], here).alias("a"), (acc["q"] != x["odd"]).alias("q"), (acc["d"] + F.when(acc["q"], x["inside"]).otherwise(x["out"])).alias("d"))

    listed = splits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "odd", "out", "inside"))).alias("s"))
    return listed.select("path", F.inline(F.aggregate("s", start, step, lambda acc: acc["a"])))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and parts of members (_CUT) of pieces (path, block, value, quoted, depth)."""
    at, rows = None, []
    quoted, depth, key, last, held, begun, places = False, 0, None, None, [], False, Counter()

    def row(part: int, k: str | None, place: int | None, text: str | None) -> None:
        rows.append((*at, part, k, place, text))

    def ended() -> None:
        if held:
            row(BEGIN if begun else MIDDLE, key, places[key] if begun else None, "".join(held))
        row(KEY, key, None, None)

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_CUT_NAMES)

    for batch in batches:
        for path, block, text, q, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, block) != at:
                if at:
                    ended()
                at, quoted, depth, key, last, held, begun, places = (path, block), q, d, None, None, [], False, Counter()
            text += "}"
            i, inside = 0, depth > 2  # inside: where this piece begins in a member, all of it belongs to that
            start = 0 if inside else None
            if quoted:
                i = _CLOSE.match(text).end()
                quoted = i == len(text)
                i += not quoted
            for m in _TOKEN.finditer(text, i):
                c = m.group()
                if c in ("{", "["):
                    if c == "[" and depth == 1:
                        key = last
                    if depth == 2 and start is None:
                        start = m.start() if c == "{" else -1  # a list or a scalar is no member
                        begun = c == "{"
                    depth += 1
                elif c in ("}", "]"):
                    depth -= 1
                    if depth == 2 and start is not None:
                        if start >= 0 and c == "}":
                            whole = "".join(held) + text[start : m.end()]
                            row(WHOLE if begun else END, key, places[key] if begun else None, whole)
                            places[key] += begun
                        held, begun, start = [], False, None
                else:
                    quoted = len(c) < 2 or c[-1] != '"' or (m.end() == len(text) and _open(c))
                    if depth == 1:
                        last = c[1:-1]
            if depth > 2 and start is not None and start >= 0:
                held.append(text[start:])
        if rows:
            yield out()
            rows = []
    if at:
        ended()
        yield out()


def _open(token: str) -> bool:
    """Whether a token that ends with the piece is a string without its end: its last quote is escaped."""
    return token[-1] != '"' or (len(token) - 1 - len(token[:-1].rstrip("\\"))) % 2 == 1


def members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, _ord, doc) of files that hold one JSON object each: their entities, or their posts where they have none. What is no object is left out."""
    pieces = _pieces(spark, paths)

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = fresh(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    begins = kept(_carried(pieces.mapInArrow(_told, "path string, block bigint, odd boolean, out bigint, inside bigint")), "splits")
    # A row a split, some 100 bytes: with splits of 128 MB, 80 MB for 100 TB. Pieces stay where they are, and in order.
    cut = kept(pieces.join(F.broadcast(begins), ["path", "block"]).select("path", "block", "value", "quoted", "depth").mapInArrow(_cut, _CUT), "cut")
    # From split to split: the key in which it begins, the split in which the member began that it begins in, and counts by key.
    empty = F.struct(
        F.array().cast("array<struct<block:bigint,key:string,origin:bigint,entities:bigint,posts:bigint>>").alias("a"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("k", "string"), ("o", "bigint"))), *(F.lit(0).cast("bigint").alias(k) for k in KEYS),
    )

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["block"].alias("block"), acc["k"].alias("key"), acc["o"].alias("origin"), *(acc[k].alias(k) for k in KEYS))
        counts = (acc[k] + x[k] + F.when(acc["k"] == k, x["early"]).otherwise(0) for k in KEYS)
        return F.struct(F.array_append(acc["a"], here).alias("a"), F.coalesce(x["last"], acc["k"]).alias("k"), F.when(x["begins"], x["block"]).otherwise(acc["o"]).alias("o"), *(c.cast("bigint").alias(k) for c, k in zip(counts, KEYS, strict=True)))

    begun = F.col("part").isin(WHOLE, BEGIN)
    infos = cut.groupBy("path", "block").agg(
        F.max(F.when(F.col("part") == KEY, F.col("key"))).alias("last"), F.coalesce(F.bool_or(F.col("part") == BEGIN), F.lit(False)).alias("begins"),
        F.count_if(begun & F.col("key").isNull()).alias("early"), *(F.count_if(begun & (F.col("key") == k)).alias(k) for k in KEYS),
    )
    listed = infos.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "last", "begins", "early", *KEYS))).alias("s"))
    states = kept(listed.select("path", F.inline(F.aggregate("s", empty, step, lambda acc: acc["a"]))).select("path", "block", F.col("key").alias("_k"), "origin", *(F.col(k).alias(f"_{k}") for k in KEYS)), "states")
    rows = cut.where(F.col("part") != KEY).join(states, ["path", "block"])
    key = F.coalesce("key", "_k")
    placed = rows.withColumn("key", key).withColumn("place", F.col("place") + F.when(key == KEYS[0], F.col(f"_{KEYS[0]}")).otherwise(F.col(f"_{KEYS[1]}")))
    whole = placed.where(F.col("part") == WHOLE).select("path", "key", "place", "text")
    # Parts of one member: those of the split where it begins, and of all that begin in it.
    parts = placed.where(F.col("part") != WHOLE).withColumn("of", F.when(F.col("part") == BEGIN, F.col("block")).otherwise(F.col("origin")))
    joined = parts.groupBy("path", "of").agg(F.max("place").alias("place"), F.max(F.when(F.col("part") == BEGIN, F.col("key"))).alias("key"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    found = kept(whole.unionByName(joined.where("of IS NOT NULL").select("path", "key", "place", "text")).where(F.col("key").isin(*KEYS)), "members")
    mine = found.groupBy("path").agg(F.min("key").alias("key"))  # entities come first
    return found.join(mine, ["path", "key"], "left_semi").select("path", F.col("place").alias("_ord"), F.to_json(F.try_parse_json("text")).alias("doc")).where("doc IS NOT NULL")
