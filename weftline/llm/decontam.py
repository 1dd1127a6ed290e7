"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

A text is its lower-cased words (runs of letters and digits) and their five-word shingles, as a set. An item with n
shingles lies in a document if at least ceil(0.8 n) of them do. Items are parted by size, class k holding those of 2^k to
2^(k+1) - 1 shingles, and an item's sketch is the least MinHash values of its shingles: so many that a document
which misses all of them misses more than the item may lose, whatever the item's size in its class. A document
whose shingles meet a sketch is a candidate, so no containing document is lost; a candidate is then
verified by the shingles themselves, as text.

Null and empty texts, and texts of fewer than five words, hold no shingles: such documents hold nothing and such
items are never found. Rows of one doc_id (or item_id) count together as one document (item); rows without an id are
left out. Repeated shingles count once. Extra columns are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stage_table, without

WORDS, CONTAINED = 5, 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingled(table: DataFrame, key: str, text: str, words_in: int) -> DataFrame:
    """(key, w) of the rows that have a shingle."""
    return table.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), words(F.col(text)).alias("w")).where(F.size("w") >= words_in)


def _at(w: str, size: int, make) -> Column:
    """array of make(size columns of w) for every place in w."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: make(*(F.get(w, i + k) for k in range(size))))


def _texts(rows: DataFrame, size: int) -> DataFrame:
    return rows.select("id", F.explode(_at("w", size, lambda *x: F.concat_ws(" ", *x))).alias("shingle"))


def contained(docs: DataFrame, items: DataFrame, size: int = WORDS, least: float = CONTAINED, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(doc_key, item_key, n_shingles, n_found, containment) of every pair with a containment of at least `least`."""
    item_rows = stage_table(_texts(_shingled(items, item_key, "text", size), size).distinct().withColumnRenamed("id", "item"), "shingles")
    sizes = item_rows.groupBy("item").agg(F.count("*").alias("n"))
    # The class's largest size sets the sketch: all that a contained item can miss, and one more.
    sized = sizes.withColumn("k", F.floor(F.log2("n")).cast("int")).withColumn("keep", F.floor((1 - least) * (F.pow(F.lit(2.0), F.col("k") + 1) - 1) + 1e-9).cast("int") + 1)
    hashed = item_rows.withColumn("h", F.xxhash64(F.transform(F.split("shingle", " "), lambda x: F.xxhash64(x))))
    # One item's shingles are as many as its words; only they are gathered in a row.
    sketch = (
        hashed.groupBy("item").agg(F.array_sort(F.collect_set("h")).alias("hs")).join(sized, "item")
        .select("item", F.explode(F.slice("hs", F.lit(1), F.col("keep"))).alias("h"))
    )
    sketch = stage_table(sketch, "sketch")
    doc_rows = _shingled(docs, doc_key, "text", size)
    hashes = doc_rows.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    places = hashes.select("id", F.explode(_at("w", size, lambda *x: F.xxhash64(F.array(*x)))).alias("h"))
    # Whether the sketches are small enough to broadcast is Spark's to tell from the written table's size.
    candidates = stage_table(places.join(sketch, "h").select("id", "item").distinct(), "candidates")
    ids = stage_table(candidates.select("id").distinct(), "ids")
    again = _texts(doc_rows.join(ids, "id", "left_semi"), size).distinct()
    wanted = candidates.join(item_rows, "item")
    found = again.join(wanted, ["id", "shingle"]).groupBy("id", "item").agg(F.count("*").alias("n_found"))
    return (
        found.join(sizes, "item").where(F.col("n_found") >= F.ceil(least * F.col("n") - 1e-9))
        .select(F.col("id").alias(doc_key), F.col("item").alias(item_key), F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))
    )


def kept(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs that hold no item; rows without an id stay. Columns stay.

    The ids that go are written first, and only texts that may be among them are moved.
    """
    gone = stage_table(contained(docs, items).select("doc_id").distinct(), "gone")
    return without(docs, gone, "doc_id")


CONTAINED_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d)),
its AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i)),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN its USING (s) GROUP BY ALL) JOIN n USING (item_id)
WHERE n_found >= ceil(0.8 * n_shingles - 1e-9)
"""
