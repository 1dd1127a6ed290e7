"""Sources: version files, listings, objects, product records, search results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.functions.urls import is_bot, links_by_kind
from weftline.operators.versions import changed, recorded
from weftline.sources import scan
from weftline.sources.publish import Files

#: Deleted comments' texts.
DELETED = ("[deleted]", "[removed]")


# --- objects ---------------------------------------------------------------------------------------------------


class Objects:
    """Whole objects of any store that Spark's file systems reach: read, write, delete, size."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm, self._root = spark, spark._jvm, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, key: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{key.lstrip('/')}")
        return path.getFileSystem(self._conf), path

    def read(self, key: str) -> bytes:
        fs, path = self._at(key)
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, key: str, data: bytes) -> None:
        """The object under another name first, then renamed over the old one: readers see the old or the new one."""
        Files(self._spark, self._root).put(key.lstrip("/"), data, overwrite=True)

    def delete(self, key: str) -> bool:
        fs, path = self._at(key)
        return fs.delete(path, False)

    def size(self, key: str) -> int:
        fs, path = self._at(key)
        return fs.getFileStatus(path).getLen()


# --- version files ---------------------------------------------------------------------------------------------


def entities(spark: SparkSession, paths: str | list[str], whole: int = 32 << 20) -> DataFrame:
    """(path, _ord, doc) of version files: their entities, or their posts where they have none; what is no object is left out.

    A file is one JSON document; its members are cut apart as JSON text, without a schema. Files of more than `whole` bytes are read by as many tasks as
    they have splits (scan.members()), smaller ones by one task each.
    """
    sizes = spark.read.format("binaryFile").load(paths).select("path", "length")
    large = [r["path"] for r in sizes.where(F.col("length") > whole).collect()]  # at most a name for each `whole` bytes
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_size").alias("size"))
    member = T.StructType([T.StructField("entities", T.ArrayType(T.VariantType())), T.StructField("posts", T.ArrayType(T.VariantType()))])
    parsed = files.where(F.col("size") <= whole).select("path", F.from_json("value", member).alias("v"))
    rows = F.when(F.size("v.entities") > 0, F.col("v.entities")).otherwise(F.col("v.posts"))
    each = parsed.select("path", F.posexplode(F.filter(rows, lambda x: F.schema_of_variant(x).startswith("OBJECT"))).alias("_i", "x"))
    found = each.select("path", F.col("_i").cast("bigint").alias("_ord"), F.to_json("x").alias("doc"))
    return found.unionByName(scan.members(spark, large)) if large else found


def write_version(df: DataFrame, folder: str, dataset_id: int, version: int, alt: bool = False) -> None:
    """(_ord, doc) as one version of the engine's own store: Parquet by dataset, version and kind, so that a version is read by path."""
    kind = "alt" if alt else "main"
    df.select("_ord", "doc").write.mode("overwrite").parquet(f"{folder}/dataset_id={dataset_id}/version={version}/kind={kind}")


def read_version(spark: SparkSession, folder: str, dataset_id: int, version: int, alt: bool = False) -> DataFrame:
    kind = "alt" if alt else "main"
    return spark.read.schema("_ord bigint, doc string").parquet(f"{folder}/dataset_id={dataset_id}/version={version}/kind={kind}")


def may_push(queue: DataFrame, dataset: DataFrame) -> DataFrame:
    """One row (allowed): whether an alternative version may be written, that is nothing is open and the dataset not frozen."""
    is_open = queue.join(dataset.select("dataset_id"), "dataset_id", "left_semi").where("status not in ('done', 'failed')").agg((F.count("*") > 0).alias("o"))
    return dataset.agg(F.coalesce(F.bool_or("is_frozen"), F.lit(True)).alias("f")).join(is_open).select((~F.col("f") & ~F.col("o")).alias("allowed"))


def save_version(df: DataFrame, versions: DataFrame, folder: str, dataset_id: int, created_at: Column) -> DataFrame:
    """versions after df (_ord, doc) is saved as the dataset's next version and made its active one; as they are where df equals the last."""
    last = versions.where(F.col("dataset_id") == dataset_id).agg(F.max("version_number")).scalar()
    number = df.sparkSession.range(1).select(last.alias("n")).first()["n"] or 0
    if number and not changed(read_version(df.sparkSession, folder, dataset_id, number), df).first()["changed"]:
        return versions
    write_version(df, folder, dataset_id, number + 1)
    row = {"dataset_id": F.lit(dataset_id), "version_number": F.lit(number + 1), "file_path": F.lit(f"{dataset_id}/v{number + 1}"), "entity_count": F.lit(df.count()), "created_at": created_at, "is_active": F.lit(True)}
    new = df.sparkSession.range(1).select(*(row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in versions.schema))
    return recorded(versions, new)


def push(df: DataFrame, queue: DataFrame, dataset: DataFrame, folder: str, dataset_id: int, version: int) -> bool:
    """Write df (_ord, doc) in place of a version's alternative, if may_push() allows it; whether it did. read_version(alt=True) pulls it."""
    allowed = bool(may_push(queue, dataset).first()["allowed"])
    if allowed:
        write_version(df, folder, dataset_id, version, alt=True)
    return allowed


def catalogue(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 16, **options: str) -> DataFrame:
    """A table of a relational catalogue by JDBC, read side by side in ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options)
    return reader.load()


def swap_table(df: DataFrame, path: str) -> None:
    """df in place of the Parquet table at path: written beside it first, then both are renamed. df may be made from what is at path.

    For a moment nothing is at path, as no file system replaces a whole folder; readers that must always find a version use Published.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    new, old, at = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", f"{path}.old", path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"{path}.new can't be put in place")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


# --- listings --------------------------------------------------------------------------------------------------

POST = "title string, selftext string, subreddit string, link_flair_text string, url string, score int, num_comments int, upvote_ratio double, created_utc double, author string, permalink string"


def posts(texts: DataFrame, text: str = "value") -> DataFrame:
    """The posts of listings: of a listing all, of a comment page (a list of two or more) its first."""
    listing = f"struct<data: struct<children: array<struct<kind: string, data: struct<{', '.join(x.replace(' ', ': ', 1) for x in POST.split(', ')) }>>>>>"
    many = F.from_json(text, f"array<{listing}>")
    page = F.ltrim(F.col(text)).startswith("[") & (F.size(many) >= 2)
    kids = lambda c: F.filter(c["data"]["children"], lambda x: x["kind"] == "t3")
    first = F.slice(kids(F.get(many, 0)), 1, 1)
    return texts.select(F.explode(F.when(page, first).otherwise(kids(F.from_json(text, listing)))).alias("p")).select("p.data.*")


def projected_posts(df: DataFrame, wanted: set[str]) -> DataFrame:
    """Posts with the fields that are asked for. A deleted body is blank and has no links."""
    gone = F.col("selftext").isin(*DELETED)
    body = F.when(gone, "").otherwise(F.col("selftext"))
    found = links_by_kind(F.coalesce(body, F.lit("")))
    columns = {"title": F.col("title"), "body": body, "subreddit": F.col("subreddit"), "flair": F.col("link_flair_text"), "url": F.col("url"), "score": F.col("score"), "num_comments": F.col("num_comments"), "upvote_ratio": F.col("upvote_ratio"), "created_utc": F.col("created_utc")}
    columns |= {k: found[k] for k in ("links", "images", "videos", "audio", "files")}
    return df.select(*(c.alias(k) for k, c in columns.items() if k in wanted))


def visible_comments(comments: DataFrame) -> DataFrame:
    """comments (comment_id, parent_id, author, body, ...) without deleted ones and bots', and without what answers those.

    parent_id is null at the top. Level after level is kept by a join with the one above; answers are ten deep at most, as
    deep as they are fetched.
    """
    mine = comments.where(~(F.coalesce("body", F.lit("")).isin("", *DELETED) | F.coalesce(is_bot(F.col("author")), F.lit(False))))
    level = mine.where("parent_id is null")
    out = level
    for _ in range(9):
        level = mine.join(level.select(F.col("comment_id").alias("parent_id")), "parent_id", "left_semi").select(*mine.columns)
        out = out.unionByName(level)
    return out


# --- products --------------------------------------------------------------------------------------------------


def product_fields(raw: Column, fields: list[str]) -> Column:
    """struct of those fields of a product's record, as JSON texts; fields it lacks are null."""
    return F.struct(*(F.get_json_object(raw, f"$['{f}']").alias(f) for f in fields))


# --- search results --------------------------------------------------------------------------------------------


class SearchSource(DataSource):
    """`format("weft_search")`: search results, by a provider given as a function of (query) -> rows of (url, title, snippet).

    Without a network the provider reads a folder of saved results: <query>.json lines under `path`.
    """

    @classmethod
    def name(cls) -> str:
        return "weft_search"

    def schema(self) -> str:
        return "query string, position int, url string, title string, snippet string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SearchReader(self.options)


class _Query(InputPartition):
    def __init__(self, text: str):
        super().__init__(text)
        self.text = text


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.queries = [q.strip() for q in options.get("queries", "").split("|") if q.strip()]

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def read(self, partition: _Query) -> Iterator[tuple]:
        import json
        import os
        import re

        file = os.path.join(self.folder, re.sub(r"[^a-z0-9]+", "-", partition.text.lower()).strip("-") + ".json")
        if not os.path.exists(file):
            return
        with open(file, encoding="utf-8") as f:
            for i, line in enumerate(f):
                row = json.loads(line)
                yield partition.text, i, row.get("url"), row.get("title"), row.get("snippet")


