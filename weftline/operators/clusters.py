"""Sharing of work: rows that ask for the same page are clustered, one does the work, the others take its result.

A key's first row and its count are aggregates, combined before they are shuffled and joined back, so that no task holds all rows
that ask for one page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import normal

MOST_ATTEMPTS = 3


def cluster(rows: DataFrame, key: list[Column], order: str, target: str, role: str = "role", primary: str = "primary") -> DataFrame:
    """rows with their role: the first of a key leads, the others wait for its `target`; a key's only row is solo.

    Null keys are a key of their own. Rows of equal order go by target; those of equal target too lead together.
    """
    named = rows.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(key)))
    names = [f"_k{i}" for i in range(len(key))]
    place = F.struct(F.col(order).alias("o"), F.col(target).alias("t"))
    heads = named.groupBy(*(F.col(k).alias(f"_h{k}") for k in names)).agg(F.count("*").alias("_n"), F.min(place).alias("_head"))
    out = named.join(heads, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in names)))
    out = out.withColumn("_first", place.eqNullSafe(F.col("_head"))).withColumn("_lead", F.col("_head.t"))
    out = out.withColumn(role, F.when(F.col("_n") == 1, "solo").when(F.col("_first"), "primary").otherwise("waiting"))
    return out.withColumn(primary, F.when(F.col(role) == "waiting", F.col("_lead"))).drop(*names, *(f"_h{k}" for k in names), "_n", "_head", "_first", "_lead")


def crawl_clusters(queue: DataFrame, url: str = "url", order: str = "queue_id", target: str = "dataset_url_id") -> DataFrame:
    """Rows that wait for the same URL, however it is spelled."""
    return cluster(queue, [normal(F.col(url))], order, target)


def schema_hash(fields: Column) -> Column:
    """SHA-256 of a map from name to definition, in order of names."""
    pairs = F.array_sort(F.map_entries(fields))
    return F.sha2(F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(":"), e["value"], F.lit("|"))), ""), 256)


def extract_clusters(queue: DataFrame, hash_of: str = "schema_hash", url: str = "url", order: str = "queue_id", target: str = "queue_id") -> DataFrame:
    """Rows that wait for the same URL and ask for the same fields."""
    return cluster(queue, [F.col(hash_of), normal(F.col(url))], order, target)


def fan_out(rows: DataFrame, results: DataFrame, target: str = "dataset_url_id", role: str = "role", primary: str = "primary") -> DataFrame:
    """(all of rows, result): waiting rows take their leader's result and are solo again; the rest keep their own. results: (target, result)."""
    wanted = rows.withColumn("_of", F.coalesce(F.when(F.col(role) == "waiting", F.col(primary)), F.col(target)))
    out = wanted.join(results.select(F.col(target).alias("_of"), "result"), "_of", "left")
    served = (F.col(role) == "waiting") & F.col("result").isNotNull()
    return out.withColumn(primary, F.when(~served, F.col(primary))).withColumn(role, F.when(served, "solo").otherwise(F.col(role))).drop("_of")


def _offered(queue: DataFrame, done: DataFrame, url: Column) -> DataFrame:
    """(queue_id, from_queue_id): the least row of done of another dataset with the same fields and URL. No pairs of a page are made."""
    key = ["schema_hash", "n"]
    a = queue.select("queue_id", "dataset_id", "schema_hash", url.alias("n"))
    b = done.where("dataset_id is not null and queue_id is not null").groupBy("schema_hash", url.alias("n"), F.col("dataset_id").alias("from")).agg(F.min("queue_id").alias("q"))
    # The least of all datasets serves all but its own, which takes the least of the others.
    least = b.groupBy(*key).agg(F.min(F.struct("q", "from")).alias("least"))
    others = b.join(least, key).where(F.col("from") != F.col("least.from")).groupBy(*key).agg(F.min("q").alias("other"))
    offers = least.join(others, key, "left").select(*key, "least", "other")
    taken = F.when(F.col("dataset_id") != F.col("least.from"), F.col("least.q")).when(F.col("dataset_id") == F.col("least.from"), F.col("other"))
    return a.join(offers, key).select("queue_id", taken.alias("from_queue_id")).where("from_queue_id is not null").groupBy("queue_id").agg(F.min("from_queue_id").alias("from_queue_id"))


def late_arrivals(queue: DataFrame, done: DataFrame) -> DataFrame:
    """(queue_id, from_queue_id): rows of other datasets with the same fields and URL as one just done; the first of those.

    queue, done: (queue_id, dataset_id, schema_hash, url).
    """
    return _offered(queue, done, normal(F.col("url")))


def reusable(queue: DataFrame, done: DataFrame) -> DataFrame:
    """(queue_id, from_queue_id) as late_arrivals(), by the URL as it is written, and of rows that wait for a version or are done."""
    return _offered(queue, done.where(F.col("status").isin("proceed-version", "done")), F.col("url"))


def failed_over(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """queue after the rows of failed (queue_id, attempts) have failed to be fetched.

    After MOST_ATTEMPTS the row and all that wait for it fail. Before, the first pending row that waits leads from now on, with the
    attempts so far; the others wait for it. A row that none waits for fails.
    """
    hit = queue.join(failed.withColumnRenamed("attempts", "_attempts"), "queue_id").select("queue_id", F.col("dataset_url_id").alias("_lead"), "_attempts")
    heir = (
        queue.where("role = 'waiting' and status = 'pending'").join(hit.select("_lead", "_attempts"), F.col("primary") == F.col("_lead"))
        .groupBy("_lead").agg(F.min_by(F.struct("queue_id", "dataset_url_id"), "queue_id").alias("_heir"))
    )
    told = hit.select("_lead", "_attempts").join(heir, "_lead", "left")
    own = hit.select("queue_id", F.lit(True).alias("_failed"))
    out = queue.join(own, "queue_id", "left").join(told, (F.col("primary") == F.col("_lead")) & (F.col("role") == "waiting"), "left")
    over = F.col("_attempts") >= MOST_ATTEMPTS
    heir_now = ~over & (F.col("_heir.queue_id") == F.col("queue_id"))
    return (
        out.withColumn("status", F.when(F.col("_failed") | over, "failed").when(heir_now, "pending").otherwise(F.col("status")))
        .withColumn("crawl_attempts", F.when(heir_now, F.col("_attempts")).otherwise(F.col("crawl_attempts")))
        .withColumn("primary", F.when(heir_now, F.lit(None)).when(~over & F.col("_heir").isNotNull(), F.col("_heir.dataset_url_id")).otherwise(F.col("primary")))
        .withColumn("role", F.when(heir_now, "primary").otherwise(F.col("role")))
        .select(*queue.columns)
    )


def diff_clusters(queue: DataFrame, status: str = "pending-diff", url: str = "url", order: str = "queue_id", target: str = "dataset_url_id") -> DataFrame:
    """The rows that wait for their page to be compared (or, by status, for their community to be read), clustered like crawl_clusters()."""
    return crawl_clusters(queue.where(F.col("status") == status), url, order, target)
