"""Ranked lexical search: a blocked sparse matrix product of item-term multiplicities and term-document impacts.

A term is a maximal run of ASCII letters and digits and of any other characters than ASCII's, A-Z in lower case. Items are parted into blocks of at most
ITEM_TERMS (item, term) entries and one item more; a block's terms and multiplicities are small enough to go to every task. For each block of items the documents are read once into rows of
(term, occurrences) for the block's terms; counts of documents come from these rows and give the weights. Documents are then taken some thousands at a
time, as a sparse matrix by terms of int64 impacts. A row of the product is merged from the matrix rows of the item's terms (Gustavson's way) in an
accumulator over the block's documents. Each block gives an item its k best, a task keeps the k best of its blocks, and these are reduced in two steps.

Scores are integers: w = floor(1000 ln((2N + 2) / (2 df + 1))) in doubles, m = 25 + (75 n N) div L, and the sum of
w * ((10^9 tf) div (1000 tf + 8 m)) over an item's terms, repeats included. N counts documents with a term, L their terms, n one document's terms.

Every row of docs is a document of its own, also where ids repeat; a null id is ranked behind others of the same score. Rows of one item id are one
item, their terms put together; items without an id are left out. Null and empty texts hold no terms: they don't count as documents and find nothing.
Fewer than k rows come for items that fewer documents share a term with (or score above 0). Very long texts are cut into terms in runs. Columns other than the id and
the text are not looked at. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from weftline.llm.common import by_bytes, give_back, small_batches, stage_table, together
from weftline.sources.scratch import numbered

#: (item, term) entries of a block of items; documents of a block, and bytes of its matrix; salts of the first of the two steps of the last reduction.
ITEM_TERMS, BLOCK_DOCS, BLOCK_BYTES, SALTS = 1 << 18, 8192, 32 << 20, 64
_BYTES, _RUN = 8 << 20, 4 << 20
#: Bytes that belong to terms, A-Z in lower case; all others are blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BLANK = re.compile(rb"[\x00-/:-@\[-`{-\x7f]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some megabytes of it at a time."""
    at = 0
    while at < len(text):
        end = at + _RUN
        blank = _BLANK.search(text, end) if end < len(text) else None
        end = blank.start() if blank else len(text)
        yield text[at:end].translate(_TABLE).split()
        at = end


def _bytes(df: DataFrame, key: str, text: str) -> DataFrame:
    return small_batches(df).select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in by_bytes(batch, 1, _BYTES):
            yield from part.to_pylist()


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term, times) of all items."""
    kind, of = items.schema[key].dataType.simpleString(), to_arrow_type(items.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            for words in terms(row["text"]):
                got = Counter(words)
                yield pa.RecordBatch.from_arrays([pa.array([row["id"]] * len(got), of), pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())], names=["id", "term", "times"])

    each = _bytes(items.where(F.col(key).isNotNull()), key, text).mapInArrow(lambda b: together(run(b)), f"id {kind}, term binary, times bigint")
    return each.groupBy("id", "term").agg(F.sum("times").alias("times"))


class Items:
    """A block of items: its terms' numbers, and by item the terms and how often each occurs."""

    def __init__(self, rows: list):
        self.number = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        self.ids = sorted({r["id"] for r in rows})
        place = {x: i for i, x in enumerate(self.ids)}
        item = np.array([place[r["id"]] for r in rows], np.int64)
        by = np.argsort(item, kind="stable")
        self.term = np.array([self.number[bytes(r["term"])] for r in rows], np.int64)[by]
        self.times = np.array([r["times"] for r in rows], np.int64)[by]
        self.begin = np.searchsorted(item[by], np.arange(len(self.ids) + 1))


def matrix(docs: DataFrame, key: str, text: str, number: dict) -> DataFrame:
    """(id, n, terms, tfs) of every document that has a term: its count of terms, and int32 arrays of those of the block's terms that it holds."""
    kind, of = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            n, got = 0, Counter()
            for words in terms(row["text"]):
                n += len(words)
                got.update(words)
            if n:
                pairs = sorted((number[t], c) for t, c in got.items() if t in number)
                made = np.array(pairs, np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([row["id"]], of), pa.array([n], pa.int64()), *(pa.array([np.ascontiguousarray(made[:, i]).tobytes()], pa.binary()) for i in (0, 1))], names=["id", "n", "terms", "tfs"])
        give_back()

    return _bytes(docs, key, text).mapInArrow(lambda b: together(run(b)), f"id {kind}, n bigint, terms binary, tfs binary")


def holders(rows: DataFrame, size: int) -> DataFrame:
    """(term, df): each term's count of documents; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            got = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            total += np.bincount(got, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    return rows.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class Impacts:
    """A block of documents as a sparse matrix by terms."""

    def __init__(self, ns: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_all: int, length: int):
        m = 25 + (75 * ns * n_all) // length
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        by = np.argsort(term, kind="stable")
        self.doc, self.impact = owner[by], impact[by]
        self.begin = np.searchsorted(term[by], np.arange(len(weight) + 1))
        self.sums = np.zeros(len(ns), np.int64)

    def product(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """One row of the product, in the accumulator: a term's documents are distinct, so plain indexing adds up."""
        self.sums[:] = 0
        for t, k in zip(term.tolist(), times.tolist(), strict=True):
            row = slice(self.begin[t], self.begin[t + 1])
            self.sums[self.doc[row]] += k * self.impact[row]
        return self.sums


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores, the first ones of equal scores."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.argsort(-score[at], kind="stable")][:k]


def best_of(rows: DataFrame, items: Items, weight: np.ndarray, n_all: int, length: int, k: int, kind: str, item_kind: str) -> DataFrame:
    """(item, doc, score): each item's k best documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0, object), np.empty(0, np.int64))] * len(items.ids)

        def ordered(ids: np.ndarray) -> np.ndarray:
            return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])), np.int64)

        def block(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            ids = np.array(table["id"].to_pylist(), object)
            by = ordered(ids)
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            sizes = np.array([len(x) // 4 for x in table["terms"].to_pylist()], np.int64)
            term, tf = (np.frombuffer(b"".join(table[c].to_pylist()), np.int32).astype(np.int64) for c in ("terms", "tfs"))
            made = Impacts(table["n"].to_numpy()[by], np.repeat(place, sizes), term, tf, weight, n_all, length)
            ids = ids[by]
            for i in range(len(items.ids)):
                part = slice(items.begin[i], items.begin[i + 1])
                score = made.product(items.term[part], items.times[part])
                if not len(at := best(score, k)):
                    continue
                both, scores = np.concatenate([kept[i][0], ids[at]]), np.concatenate([kept[i][1], score[at]])
                first = ordered(both)
                keep = first[best(scores[first], k)]
                kept[i] = both[keep], scores[keep]

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_DOCS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
                block(held)
                held = []
        if held:
            block(held)
        for i in range(0, len(items.ids), 1024):
            some = [(items.ids[j], d, int(s)) for j in range(i, min(i + 1024, len(items.ids))) for d, s in zip(*kept[j], strict=True)]
            yield pa.RecordBatch.from_pylist([{"item": a, "doc": d, "score": s} for a, d, s in some], schema) if some else pa.RecordBatch.from_pylist([], schema)
        give_back()

    spark_schema = StructType.fromDDL(f"item {item_kind}, doc {kind}, score bigint")
    schema = to_arrow_schema(spark_schema)
    return rows.mapInArrow(run, spark_schema)


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("item", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", most: int = ITEM_TERMS) -> DataFrame:
    """(item_key, rank, doc_key, score): each item's k best documents; equal scores by ascending id."""
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, doc_key), (items, item_key)))
    queries = stage_table(item_terms(items, item_key, text), "items")
    sizes = queries.groupBy("id").agg(F.count("*").alias("size"))
    dealt = stage_table(numbered(sizes, [F.col("id")], "before", F.col("size")).select("id", F.floor(F.col("before") / most).alias("block")), "dealt")
    queries = stage_table(queries.join(dealt, "id"), "blocks")
    found = []
    for number in range((queries.agg(F.max("block")).first()[0] if not queries.isEmpty() else -1) + 1):
        # At most `most` entries and those of one item.
        part = Items(queries.where(F.col("block") == number).select("id", "term", "times").collect())
        if not part.ids:
            continue
        rows = stage_table(matrix(docs, doc_key, text, part.number), "matrix")
        n_all, length = rows.agg(F.count("*"), F.sum("n")).first()
        held = np.zeros(len(part.number), np.int64)
        for r in holders(rows, len(held)).collect():  # as many as the block's terms
            held[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
        found.append(best_of(small_batches(rows), part, weight, n_all, length or 1, k, kind, item_kind))
    if not found:
        return docs.sparkSession.createDataFrame([], f"`{item_key}` {item_kind}, rank int, `{doc_key}` {kind}, score bigint")
    task = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    all_ = reduce(DataFrame.unionByName, (f.withColumn("salt", task) for f in found))
    return _first(_first(all_, k, "salt").drop("rank"), k).select(F.col("item").alias(item_key), "rank", F.col("doc").alias(doc_key), "score")


SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(w) AS t FROM i) GROUP BY ALL),
g AS (SELECT count(*) AS n_all, sum(len(w))::BIGINT AS l_all FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (
  SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * n_all + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_all) // l_all))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN df USING (t) CROSS JOIN g GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
