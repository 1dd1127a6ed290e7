"""Versions of a dataset: reading, saving, comparing, combining and cloning them.

An entity is a row (_ord, doc, ...): its place in the version and its JSON text. Comparisons of typed tables, which need no JSON,
stand beside those of entities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import jsonops
from weftline.functions.scalars import canonical
from weftline.operators import pairing
from weftline.operators.pairing import LEAST_SIMILARITY, LEAST_WEIGHT
from weftline.sources.scratch import fresh, numbered


# --- whether and how versions differ ---------------------------------------------------------------------------


def typed_changed(old: DataFrame, new: DataFrame, order: str = "_ord") -> DataFrame:
    """One row (changed): whether lengths or any field of any place differ; nulls equal each other."""
    names = [c for c in old.columns if c != order]
    a, b = old.select(order, F.struct(*names).alias("a")), new.select(order, F.struct(*names).alias("b"))
    return a.join(b, order, "full").agg(F.coalesce(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))), F.lit(False)).alias("changed"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """typed_changed() of entities: the JSON texts of one place are compared in canonical form."""
    return typed_changed(_canonical(old), _canonical(new))


def _canonical(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([canonical(jsonops.decode(t)) for t in b.column(1).to_pylist()], pa.string())], names=["_ord", "doc"])

    return df.select(F.col("_ord").cast("bigint"), "doc").mapInArrow(run, "_ord bigint, doc string")


def posts_changed(old: DataFrame, new: DataFrame, url: str = "url") -> DataFrame:
    """One row (changed): whether the count or the addresses in order differ. Hashes are taken of blocks of places, not of one long text."""

    def blocks(df: DataFrame) -> DataFrame:
        part = F.floor(F.col("_ord") / 10_000).alias("_b")
        return df.groupBy(part).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", url))), lambda x: F.coalesce(x[url], F.lit(""))), "\n"), 256).alias("h"), F.count("*").alias("n"))

    a, b = blocks(old).select("_b", F.struct("h", "n").alias("a")), blocks(new).select("_b", F.struct("h", "n").alias("b"))
    return a.join(b, "_b", "full").agg(F.coalesce(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))), F.lit(False)).alias("changed"))


def typed_weights(df: DataFrame, names: list[str]) -> DataFrame:
    """(field, weight): distinct values by rows. One pass; a field that is null everywhere weighs 1 / rows, as null is a value."""
    n = F.count("*")
    each = [F.struct(F.lit(c).alias("field"), ((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) / n).alias("weight")) for c in names]
    return df.agg(F.array(*each).alias("w")).select(F.inline("w"))


def weights(df: DataFrame) -> DataFrame:
    """(field, weight) of entities' fields, the source aside: distinct JSON values by entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(k, canonical(v)) for t in b.column(0).to_pylist() for k, v in (jsonops.decode(t) or {}).items() if k != "_source"]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["field", "value"])

    values = df.select("doc").mapInArrow(run, "field string, value string").distinct()
    return values.groupBy("field").agg((F.count("*") / df.agg(F.count("*")).scalar()).alias("weight"))


def similarity(a: dict, b: dict, weight: dict[str, float]) -> float:
    """The weights of a's fields that are equal in b and not null there."""
    shared = (k for k in a if k != "_source" and b.get(k) is not None)
    return sum(max(weight.get(k, 0.0), LEAST_WEIGHT) for k in shared if canonical(a[k]) == canonical(b[k]))


def field_changes(a: dict, b: dict) -> list[str]:
    """Fields that differ, missing as null."""
    return sorted(k for k in a.keys() | b.keys() if k != "_source" and canonical(a.get(k)) != canonical(b.get(k)))


def paired(old: list[dict], new: list[dict], weight: dict[str, float]) -> list[tuple[int, int]]:
    """Pairs of places: each of old in turn takes the likest of new that is free, if it is like enough.

    The lightest fields, which together are not enough, bring no candidates: entities that are like enough share a value of another
    one too. An index of those fields' values names the candidates; what is taken leaves it, so it is never met again.
    """

    def worth(k: str) -> float:
        return max(weight.get(k, 0.0), LEAST_WEIGHT)

    ours, theirs = ([{k: canonical(v) for k, v in e.items() if k != "_source" and v is not None} for e in side] for side in (old, new))
    light, together = set(), 0.0
    for k in sorted({k for e in ours for k in e} & {k for e in theirs for k in e}, key=lambda k: (worth(k), k)):
        together += worth(k)
        if together >= LEAST_SIMILARITY - 1e-9:
            break
        light.add(k)
    index: dict[tuple[str, str], set[int]] = {}
    for j, e in enumerate(theirs):
        for pair in e.items():
            if pair[0] not in light:
                index.setdefault(pair, set()).add(j)
    out = []
    for i, e in enumerate(ours):
        score: dict[int, float] = {}
        for j in set().union(*(index.get(pair, ()) for pair in e.items())):
            score[j] = 0.0
            for k, v in e.items():
                if theirs[j].get(k) == v:
                    score[j] += worth(k)
        if score:
            j = min(score, key=lambda j: (-score[j], j))
            if score[j] >= LEAST_SIMILARITY:
                out.append((i, j))
                for pair in theirs[j].items():
                    if pair in index:
                        index[pair].discard(j)
    return out


DIFF = "change string, source string, v1 string, v2 string, fields array<string>"
_ENTITY = "source string, hash string, doc string, tokens array<struct<field:string,value:string>>"


def _told(df: DataFrame, side: int) -> DataFrame:
    """(source, hash, doc, tokens, side) of entities: tokens are the fields that are not null, with a digest of their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                e = jsonops.decode(t)
                if isinstance(e, dict):
                    src = e.get("_source")
                    tokens = [{"field": k, "value": hashlib.sha256(canonical(v).encode()).hexdigest()} for k, v in e.items() if k != "_source" and v is not None]
                    rows.append((src if isinstance(src, str) else "", jsonops.entity_hash(e), canonical(e), tokens))
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["source", "hash", "doc", "tokens"])

    return df.select("doc").mapInArrow(run, _ENTITY).withColumn("side", F.lit(side))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, source, v1, v2, fields): entities added, subtracted and modified between two versions, by source.

    A source on one side only gives all its entities. Others lose repeats and what both sides have, by a join on hashes; the
    rest is paired as pairing.matched() does. All of it is joins, aggregations and sorts on entities, so a source of any size spreads over the cluster.
    """
    counted = _told(old, 1).unionByName(_told(new, 2)).groupBy("source", "hash", "side").agg(F.count("*").alias("n"), F.any_value("doc").alias("doc"), F.any_value("tokens").alias("tokens"))
    path = fresh(old.sparkSession, "entities")
    counted.write.parquet(path)
    counted = old.sparkSession.read.schema(counted.schema).parquet(path)
    sides = counted.groupBy("source").agg((F.min("side") == F.max("side")).alias("alone"))
    # One row a source: joined, and split by Spark where a source is large.
    known = counted.join(sides, "source")
    v = lambda k: F.when(F.col("side") == k, F.col("doc"))
    none = F.array().cast("array<string>")
    one = lambda df: df.select(F.when(F.col("side") == 1, "subtracted").otherwise("added").alias("change"), "source", v(1).alias("v1"), v(2).alias("v2"), none.alias("fields"))
    whole = one(known.where("alone").withColumn("i", F.explode(F.sequence(F.lit(1), "n"))))
    single = counted.groupBy("source", "hash").agg(F.min("side").alias("side"), F.max("side").alias("other"), F.max("doc").alias("doc"), F.any_value("tokens").alias("tokens")).where("side = other")
    rest = single.join(sides.where("not alone"), "source", "left_semi").select("source", "side", "hash", "doc", "tokens")
    path = fresh(old.sparkSession, "rest")
    rest.write.parquet(path)
    rest = old.sparkSession.read.schema(rest.schema).parquet(path)
    larger = new if new.count() > old.count() else old
    tokens = rest.select("source", "side", "hash", F.explode("tokens").alias("t")).select("source", "side", "hash", "t.field", "t.value")
    pairs = pairing.matched(tokens, weights(larger))
    sided = lambda k, name: rest.where(F.col("side") == k).select("source", F.col("hash").alias(name), F.col("doc").alias(f"v{k}"))
    both = pairs.join(sided(1, "old"), ["source", "old"]).join(sided(2, "new"), ["source", "new"]).select("source", "v1", "v2")

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [field_changes(jsonops.decode(x), jsonops.decode(y)) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(["modified"] * b.num_rows), *b.columns, pa.array(found, pa.list_(pa.string()))], names=["change", "source", "v1", "v2", "fields"])

    ends = pairs.select("source", F.lit(1).alias("side"), F.col("old").alias("hash")).unionByName(pairs.select("source", F.lit(2).alias("side"), F.col("new").alias("hash")))
    return whole.unionByName(one(rest.join(ends, ["source", "side", "hash"], "left_anti"))).unionByName(both.mapInArrow(fields, DIFF))


def typed_diff(old: DataFrame, new: DataFrame, names: list[str]) -> DataFrame:
    """The rows of typed tables that only one of them has: (side, all names), 1 for old and 2 for new; repeats count once."""
    a, b = old.select(*names, F.lit(1).alias("side")), new.select(*names, F.lit(2).alias("side"))
    return a.unionByName(b).groupBy(*names).agg(F.min("side").alias("side"), F.max("side").alias("_o")).where("side = _o").drop("_o")


def typed_field_changes(old: DataFrame, new: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """(key, fields): the names that differ in rows of one key, of those keys where any does."""
    b = new.select(*key, *(F.col(c).alias(f"_{c}") for c in names))
    found = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in sorted(names))))
    return old.join(b, key).select(*key, found.alias("fields")).where(F.size("fields") > 0)


# --- catalogue of versions -------------------------------------------------------------------------------------


def next_version(versions: DataFrame, dataset_id: int) -> DataFrame:
    """One row (version): 1, or one more than the last."""
    return versions.where(F.col("dataset_id") == dataset_id).agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("version"))


def resolve(versions: DataFrame, datasets: DataFrame, wanted: str, alt: bool = False) -> DataFrame:
    """(dataset_id, version_number, path): `active`, `latest` or `vN` of each dataset; alt: of those that have an alternative."""
    if wanted in ("active", ""):
        picked = versions.join(datasets.select("dataset_id", F.col("active_version").alias("version_number")), ["dataset_id", "version_number"], "left_semi")
    elif wanted == "latest":
        picked = versions.groupBy("dataset_id").agg(F.max_by(F.struct(*versions.columns), "version_number").alias("r")).select("r.*")
    else:
        number = wanted.removeprefix("v")
        picked = versions.where(F.col("version_number") == (int(number) if number.isdecimal() else -1))
    if alt:
        return picked.where(F.trim(F.coalesce("alt_file_path", F.lit(""))) != "").select("dataset_id", "version_number", F.col("alt_file_path").alias("path"))
    return picked.select("dataset_id", "version_number", F.col("file_path").alias("path"))


def recorded(versions: DataFrame, new: DataFrame) -> DataFrame:
    """versions with new's rows in place of those of the same (dataset_id, version_number), and one active version a dataset: new's."""
    key = ["dataset_id", "version_number"]
    joined = versions.join(new, key, "left_anti").unionByName(new.select(*versions.columns))
    latest = new.groupBy("dataset_id").agg(F.max("version_number").alias("_v"))
    return joined.join(latest, "dataset_id", "left").withColumn("is_active", F.when(F.col("_v").isNull(), F.col("is_active")).otherwise(F.col("version_number") == F.col("_v"))).select(*versions.columns)


def purged(versions: DataFrame, datasets: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions without broken (dataset_id, version_number), and datasets with their last remaining version as the active one, 0 for none."""
    left = versions.join(broken, ["dataset_id", "version_number"], "left_anti")
    last = left.groupBy("dataset_id").agg(F.max("version_number").alias("_v"))
    hit = broken.select("dataset_id").distinct().withColumn("_hit", F.lit(True))
    fixed = datasets.join(hit, "dataset_id", "left").join(last, "dataset_id", "left")
    return left, fixed.withColumn("active_version", F.when(F.col("_hit"), F.coalesce("_v", F.lit(0))).otherwise(F.col("active_version"))).select(*datasets.columns)


def rolled_back(datasets: DataFrame, versions: DataFrame, dataset_id: int, version: int, freeze: bool = False) -> DataFrame:
    """datasets with the version as the active one, where it exists."""
    there = versions.where((F.col("dataset_id") == dataset_id) & (F.col("version_number") == version)).select("dataset_id").distinct().withColumn("_hit", F.lit(True))
    out = datasets.join(there, "dataset_id", "left").withColumn("active_version", F.when(F.col("_hit"), F.lit(version)).otherwise(F.col("active_version")))
    if freeze:
        out = out.withColumn("is_frozen", F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("is_frozen")))
    return out.select(*datasets.columns)


def ready(queue: DataFrame, group: str = "dataset_id", status: str = "status") -> DataFrame:
    """The groups of which every row is done, failed or waits for its version."""
    return queue.groupBy(group).agg(F.bool_and(F.col(status).isin("done", "failed", "proceed-version")).alias("_all")).where("_all").select(group)


def combined(queue: DataFrame, extracts: DataFrame, group: str = "dataset_id") -> DataFrame:
    """(group, _ord, doc): entities of ready groups' rows that wait for a version, by queue_id and place, with their _source.

    extracts: (queue_id, source_url, entities array<string of JSON>), a row for each queue_id. Places run from 0 within a group; they come from the
    sizes of the rows in order (numbered()), so no group is ever in one task and entities are not sorted.
    """
    rows = queue.where("status = 'proceed-version'").join(ready(queue, group), group, "left_semi").join(extracts, "queue_id")
    sizes = numbered(rows.select(group, "queue_id", F.size("entities").alias("_s")), [F.col(group), F.col("queue_id")], "_at", F.col("_s"))
    first = sizes.groupBy(group).agg(F.min("_at").alias("_first"))
    places = sizes.join(first, group).select(group, "queue_id", (F.col("_at") - F.col("_first")).alias("_before"))
    rows = rows.join(places, [group, "queue_id"])
    each = rows.select(group, "source_url", "_before", F.posexplode("entities").alias("_i", "doc"))
    return each.select(group, (F.col("_before") + F.col("_i")).cast("bigint").alias("_ord"), with_source(F.col("doc"), F.col("source_url")).alias("doc"))


def with_source(doc: Column, source: Column) -> Column:
    """An entity's JSON text with _source."""

    @F.pandas_udf("string")
    def put(doc: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([canonical({**(jsonops.decode(d) or {}), "_source": s}) for d, s in zip(doc, source, strict=True)])

    return put(doc, source)


def cloned(datasets: DataFrame, versions: DataFrame, urls: DataFrame, source: int, new: int, user: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with a copy of dataset `source` as `new`: its latest version as version 1, its URLs, and one clone more."""
    mine = datasets.where(F.col("dataset_id") == source)
    copy = mine.withColumn("dataset_id", F.lit(new).cast(datasets.schema["dataset_id"].dataType)).withColumn("user_id", F.lit(user)).withColumn("is_cloned", F.lit(True)).withColumn("cloned_from", F.lit(source).cast("bigint")).withColumn("clone_count", F.lit(0).cast(datasets.schema["clone_count"].dataType)).withColumn("active_version", F.lit(1).cast(datasets.schema["active_version"].dataType))
    counted = datasets.withColumn("clone_count", F.when(F.col("dataset_id") == source, F.col("clone_count") + 1).otherwise(F.col("clone_count")).cast(datasets.schema["clone_count"].dataType))
    last = versions.where(F.col("dataset_id") == source).orderBy(F.col("version_number").desc()).limit(1)
    last = last.withColumn("dataset_id", F.lit(new).cast(versions.schema["dataset_id"].dataType)).withColumn("version_number", F.lit(1).cast(versions.schema["version_number"].dataType)).withColumn("is_active", F.lit(True))
    more = urls.where(F.col("dataset_id") == source).withColumn("dataset_id", F.lit(new).cast(urls.schema["dataset_id"].dataType))
    return counted.unionByName(copy.select(*datasets.columns)), versions.unionByName(last.select(*versions.columns)), urls.unionByName(more.select(*urls.columns))


def file_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, count, size) of version files: their told total, or the length of posts, or of entities."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("t"))
    at = lambda p, k: F.get_json_object("t", p).try_cast(k)
    length = lambda p: F.coalesce(F.json_array_length(F.get_json_object("t", p)), F.lit(0))
    count = F.coalesce(F.when(at("$.total", "bigint") > 0, at("$.total", "bigint")), F.nullif(length("$.posts"), F.lit(0)), length("$.entities"))
    return files.select("path", count.cast("bigint").alias("count"), "size")
