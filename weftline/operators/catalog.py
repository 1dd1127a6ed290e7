"""Reports, sweeps and repairs over the catalogue's tables.

Tables are DataFrames; a change is a new DataFrame of the same columns. Times are parameters, so that a report of one moment
stays the same. Correlated subqueries are joins to one row a key, found by max_by or by a semi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.scratch import numbered, placed

#: Datasets, URLs and search results that a plan allows, and whether it may ping and send webhooks.
PLANS = {"free": (1, 20, 10, False, False), "starter": (5, 100, 40, True, True)}
STUCK_LOCK_S, STUCK_STAGE_S, CRAWL_S = 1800, 7200, 1800
ENDED = ("done", "failed")
#: What a refresh sets in a row of the queue; `role` and `primary` stand for its cluster.
RESET = {"status": "pending-diff", "crawl_type": "nightly-recrawl", "role": "solo", "primary": None, "cluster_attempts": 0, "diff_role": "solo", "diff_primary": None}


# --- parts of reports ------------------------------------------------------------------------------------------


def display_name(alias: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(alias), F.lit("")), name)


def flagged(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with whether other has a row of its keys."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def latest_status(urls: DataFrame, *queues: tuple[DataFrame, str], default: str = "pending", key: str = "dataset_url_id") -> DataFrame:
    """urls with queue_status: of the newest row of the first queue that has any. queues: (table, its id column)."""
    parts = []
    for i, (q, number) in enumerate(queues):
        urls = urls.join(q.groupBy(key).agg(F.max_by("status", number).alias(f"_s{i}")), key, "left")
        parts.append(F.col(f"_s{i}"))
    return urls.withColumn("queue_status", F.coalesce(*parts, F.lit(default))).drop(*(f"_s{i}" for i in range(len(queues))))


def open_rows(urls: DataFrame, *queues: DataFrame) -> DataFrame:
    """(dataset_id) of datasets with a row in any queue that is neither done nor failed."""
    found = [q.where(~F.col("status").isin(*ENDED)).select("dataset_url_id").join(urls.select("dataset_url_id", "dataset_id"), "dataset_url_id").select("dataset_id") for q in queues]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def versions_list(versions: DataFrame) -> DataFrame:
    """(dataset_id, versions): numbers joined by commas, the last first."""
    return versions.groupBy("dataset_id").agg(F.array_join(F.sort_array(F.collect_list("version_number"), asc=False), ",").alias("versions"))


def derived_status(frozen: Column, is_open: Column, has_versions: Column) -> Column:
    return F.when(frozen, "frozen").when(is_open | ~has_versions, "processing").otherwise("active")


def kind(df: DataFrame, schemas: DataFrame, subreddits: DataFrame, name: str = "dataset_type") -> DataFrame:
    """df with web, amazon or reddit: by its own type, its communities, or its schema's source."""
    out = flagged(df.join(schemas.select("dataset_id", F.col("source").alias("_src")), "dataset_id", "left"), subreddits, ["dataset_id"], "_sub")
    return out.withColumn(name, F.when(F.col("dataset_type") == "amazon", "amazon").when(F.col("_sub") | (F.col("_src") == "reddit"), "reddit").otherwise("web")).drop("_src", "_sub")


def active_rows(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """(dataset_id, entity_count, has_alt, refreshed) of each dataset's active version."""
    on = datasets.select("dataset_id", F.col("active_version").alias("version_number"))
    return versions.join(on, ["dataset_id", "version_number"]).groupBy("dataset_id").agg(
        F.max("entity_count").alias("entity_count"), F.bool_or(F.coalesce("alt_file_path", F.lit("")) != "").alias("has_alt"), F.max("created_at").alias("refreshed")
    )


# --- reports ---------------------------------------------------------------------------------------------------


def market(datasets: DataFrame, versions: DataFrame, schemas: DataFrame, subreddits: DataFrame, as_of: Column) -> DataFrame:
    """Public datasets that have a version, the best first: clones count three, calls one, and a day of age costs half."""
    rows = datasets.where("visibility = 'public' and active_version is not null").join(versions.select("dataset_id"), "dataset_id", "left_semi")
    rows = kind(rows, schemas, subreddits).join(active_rows(datasets, versions), "dataset_id", "left")
    rank = F.col("clone_count") * 3 + F.col("api_hit_count") - F.datediff(as_of, F.col("created_at")) * 0.5
    return rows.select(
        "dataset_id", "data_name", F.coalesce("alias", "data_name").alias("alias"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("tag", F.lit("")).alias("tag"), "is_premium", "price", "clone_count", "api_hit_count", "active_version", "created_at", "dataset_type",
        F.coalesce("has_alt", F.lit(False)).alias("has_alt"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), rank.alias("rank"),
    ).orderBy(F.col("rank").desc(), "dataset_id")


def my_datasets(datasets: DataFrame, versions: DataFrame, schemas: DataFrame, subreddits: DataFrame, urls: DataFrame, queue: DataFrame, reddit_queue: DataFrame, user: str | None = None) -> DataFrame:
    """A user's datasets (or all users') with their state, the newest first."""
    mine = datasets if user is None else datasets.where(F.col("user_id") == user)
    rows = kind(mine, schemas, subreddits).join(active_rows(datasets, versions), "dataset_id", "left").join(versions_list(versions), "dataset_id", "left")
    rows = flagged(rows, open_rows(urls, queue, reddit_queue), ["dataset_id"], "_open")
    return rows.select(
        "dataset_id", "user_id", display_name(F.col("alias"), F.col("data_name")).alias("name"), F.coalesce("refreshed", "created_at").alias("last_refresh"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("versions", F.lit("")).alias("versions"), F.col("dataset_type").alias("source"),
        F.coalesce("has_alt", F.lit(False)).alias("has_alt"), derived_status(F.col("is_frozen"), F.col("_open"), F.col("versions").isNotNull()).alias("status"), "created_at",
    ).orderBy(F.col("created_at").desc(), "dataset_id")


def profile(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """(user_id, public_datasets, clones, api_hits, versions) of every user with a dataset."""
    per = versions.groupBy("dataset_id").agg(F.count("*").alias("_v"))
    return datasets.join(per, "dataset_id", "left").groupBy("user_id").agg(
        F.count_if(F.col("visibility") == "public").alias("public_datasets"), F.coalesce(F.sum("clone_count"), F.lit(0)).alias("clones"),
        F.coalesce(F.sum("api_hit_count"), F.lit(0)).alias("api_hits"), F.coalesce(F.sum("_v"), F.lit(0)).alias("versions"),
    )


def dataset_view(
    datasets: DataFrame, schemas: DataFrame, versions: DataFrame, files: DataFrame, urls: DataFrame, queue: DataFrame, reddit_queue: DataFrame, only: DataFrame | None = None
) -> dict[str, DataFrame]:
    """What a dataset's page shows, as three tables: "dataset", "versions" and "urls"; of all datasets, or those of only (dataset_id).

    A dataset with very many versions or URLs stays spread: they are rows, in the page's order when sorted by (dataset_id, version_number) and
    (dataset_id, dataset_url_id), never a list in one row. What the page says of all of them are aggregates. files: (file_path, bytes).
    Processing is a dataset with a URL whose newest row is open or missing; entity_count and file_size_bytes are the active version's, of several
    of one number the least path's; last_refresh is the last version's. A dataset without a schema, or one that isn't an object, has a null schema.
    """
    if only is not None:
        datasets = datasets.join(only.select("dataset_id").distinct(), "dataset_id", "left_semi")
    mine = datasets.select("dataset_id")
    sizes = files.groupBy("file_path").agg(F.max("bytes").alias("_bytes"))
    listed = versions.join(mine, "dataset_id", "left_semi").join(sizes, "file_path", "left").select(
        "dataset_id", "version_number", "file_path", F.nullif("alt_file_path", F.lit("")).alias("alt_file_path"), "created_at", "is_active", "entity_count",
        F.coalesce("_bytes", F.lit(0)).cast("bigint").alias("file_size_bytes"),
    )
    own = latest_status(urls.join(mine, "dataset_id", "left_semi"), (queue, "queue_id"), (reddit_queue, "reddit_queue_id")).select("dataset_id", "dataset_url_id", "url", "source_type", "queue_status", "folder_path")
    last = listed.groupBy("dataset_id").agg(F.max_by("created_at", F.struct("version_number", "file_path")).alias("_last"))
    active = listed.join(datasets.select("dataset_id", F.col("active_version").alias("version_number")), ["dataset_id", "version_number"])
    active = active.groupBy("dataset_id").agg(F.min_by(F.struct("entity_count", "file_size_bytes"), "file_path").alias("_active"))
    waits = own.groupBy("dataset_id").agg(F.bool_or(~F.col("queue_status").isin(*ENDED)).alias("_open"))
    fields = schemas.groupBy("dataset_id").agg(F.max("fields").alias("_fields"))
    head = datasets.join(fields, "dataset_id", "left").join(last, "dataset_id", "left").join(active, "dataset_id", "left").join(waits, "dataset_id", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return {
        "dataset": head.select(
            "dataset_id", "user_id", F.col("data_name").alias("name"), blank("description"), blank("intent"), blank("extract_intent"), blank("tag"), "visibility",
            flag("is_frozen").alias("is_frozen"), flag("is_cloned").alias("is_cloned"), flag("nightly").alias("nightly"), derived_status(flag("is_frozen"), flag("_open"), F.lit(True)).alias("status"),
            F.coalesce("active_version", F.lit(0)).alias("active_version"), "created_at", F.coalesce("_last", "created_at").alias("last_refresh"), F.from_json("_fields", "map<string,string>").alias("schema"),
            F.coalesce("_active.entity_count", F.lit(0)).cast("bigint").alias("entity_count"), F.coalesce("_active.file_size_bytes", F.lit(0)).cast("bigint").alias("file_size_bytes"), "dataset_type",
        ),
        "versions": listed,
        "urls": own,
    }


def keepalive(*tables: tuple[str, DataFrame, str]) -> DataFrame:
    """One row of counts over whole tables: (name, table, column to count apart)."""
    parts = [t.agg(F.count("*").alias(f"{n}_rows"), F.count_distinct(c).alias(f"{n}_distinct"), F.max(c).alias(f"{n}_last")) for n, t, c in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)
    return out


def batch(queue: DataFrame, size: int = 20, attempts: int = 3) -> DataFrame:
    """The rows to fetch next: fewest attempts first, then small datasets, then the oldest; those that wait for others aside."""
    todo = queue.where((F.col("status") == "pending") & (F.col("role") != "waiting") & (F.col("crawl_attempts") < attempts))
    sizes = queue.groupBy("dataset_id").agg(F.count("*").alias("_n"))
    return todo.join(sizes, "dataset_id").orderBy("crawl_attempts", "_n", "created_at", "queue_id").limit(size).drop("_n")


def without_open(datasets: DataFrame, urls: DataFrame, queue: DataFrame) -> DataFrame:
    """Datasets none of whose rows is open: an anti-join."""
    return datasets.join(open_rows(urls, queue), "dataset_id", "left_anti")


def notifications(table: DataFrame, user: str, limit: int = 50) -> DataFrame:
    return table.where(F.col("user_id") == user).orderBy(F.col("created_at").desc(), F.col("notification_id").desc()).limit(limit)


# --- plans -----------------------------------------------------------------------------------------------------


def plan_limit(plan: Column, which: int) -> Column:
    """A plan's allowance; unknown plans are free."""
    out = F.lit(PLANS["free"][which])
    for name, limits in PLANS.items():
        out = F.when(plan == name, limits[which]).otherwise(out)
    return out


def over_cap(datasets: DataFrame, users: DataFrame) -> DataFrame:
    """datasets with those beyond their owner's plan frozen: all but the oldest."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "dataset_id"))
    rows = datasets.withColumn("_place", place).join(users.select("user_id", "plan"), "user_id", "left")
    over = F.col("_place") > plan_limit(F.coalesce("plan", F.lit("free")), 0)
    return rows.withColumn("is_frozen", F.col("is_frozen") | over).withColumn("nightly", F.col("nightly") & ~over).select(*datasets.columns)


def gates(datasets: DataFrame, users: DataFrame, urls: DataFrame) -> DataFrame:
    """(dataset_id, urls, url_limit, url_room, serp, serp_limit): what an owner's plan leaves room for. Discovery addresses don't count."""
    n = urls.where("url_type <> 'discovery'").groupBy("dataset_id").agg(F.count("*").alias("urls"), F.count_if(F.col("source_type") == "serp").alias("serp"))
    rows = datasets.join(users.select("user_id", "plan"), "user_id", "left").join(n, "dataset_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("dataset_id", zero("urls").alias("urls"), plan_limit(F.col("plan"), 1).alias("url_limit"), F.greatest(plan_limit(F.col("plan"), 1) - zero("urls"), F.lit(0)).alias("url_room"), zero("serp").alias("serp"), plan_limit(F.col("plan"), 2).alias("serp_limit"))


def expired(users: DataFrame, as_of: Column) -> DataFrame:
    """users with plans that have run out changed to the pending one, or free."""
    out = (F.col("plan") != "free") & (F.col("plan_expires_at") <= as_of)
    rows = users.withColumn("_out", F.coalesce(out, F.lit(False)))
    return (
        rows.withColumn("plan", F.when(F.col("_out"), F.coalesce("pending_plan", F.lit("free"))).otherwise(F.col("plan")))
        .withColumn("plan_expires_at", F.when(~F.col("_out"), F.col("plan_expires_at"))).withColumn("pending_plan", F.when(~F.col("_out"), F.col("pending_plan"))).select(*users.columns)
    )


# --- changes ---------------------------------------------------------------------------------------------------


def _asked(requests: DataFrame, found: DataFrame, refusals: list[tuple[Column, str]]) -> DataFrame:
    """(request_id, dataset_id, status, error) of requests joined to what they name: the first refusal that holds, else queued."""
    error = F.coalesce(*(F.when(holds, F.lit(why)) for holds, why in refusals))
    return found.withColumn("error", error).select(*requests.columns, F.when(F.col("error").isNull(), "queued").otherwise("error").alias("status"), "error")


def nightly(datasets: DataFrame) -> DataFrame:
    """(dataset_id) of datasets that are refreshed each night: those that ask for it and are not frozen."""
    return datasets.where(F.coalesce("nightly", F.lit(False)) & ~F.coalesce("is_frozen", F.lit(False))).select("dataset_id")


def asked_by_users(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """requests (user_id, dataset_id and others) with status and error: a refresh asked for by hand, one by one or many at once.

    Refused are datasets that there are none of, then those of others, then frozen ones. A null dataset_id is not found; a repeated request is answered each time.
    """
    known = datasets.select(F.col("dataset_id").alias("_id"), F.col("user_id").alias("_owner"), F.coalesce("is_frozen", F.lit(False)).alias("_frozen"))
    found = requests.join(known, F.col("dataset_id") == F.col("_id"), "left")
    return _asked(requests, found, [(F.col("_id").isNull(), "not found"), (~F.col("_owner").eqNullSafe(F.col("user_id")), "forbidden"), (F.col("_frozen"), "dataset is frozen")])


def pinged(pings: DataFrame, datasets: DataFrame, users: DataFrame) -> DataFrame:
    """pings (ping_key and others) with dataset_id, status and error: a refresh asked for by an address that only the owner knows.

    Refused are unknown keys, then owners whose plan allows no pings, then frozen datasets.
    """
    # An owner's plan is found for the datasets first: few are pinged, and pings may all be one dataset's.
    plans = users.select(F.col("user_id").alias("_owner"), "plan")
    keyed = datasets.where("ping_key IS NOT NULL").select(F.col("ping_key").alias("_key"), "dataset_id", F.col("user_id").alias("_owner"), F.coalesce("is_frozen", F.lit(False)).alias("_frozen"))
    keyed = keyed.join(plans, "_owner", "left").withColumn("_may", plan_limit(F.coalesce("plan", F.lit("free")), 3))
    found = pings.join(keyed.select("_key", "dataset_id", "_frozen", "_may"), F.col("ping_key") == F.col("_key"), "left")
    told = _asked(found.select(*pings.columns, "dataset_id"), found, [(F.col("_key").isNull(), "invalid ping key"), (~F.col("_may"), "plan"), (F.col("_frozen"), "dataset is frozen")])
    return told.withColumn("dataset_id", F.when(F.col("error").isNull(), F.col("dataset_id")))


def refreshed(queue: DataFrame, urls: DataFrame, datasets: DataFrame) -> DataFrame:
    """queue with the ended rows of datasets (dataset_id) waiting to be compared again, unless they failed 7 times.

    Such rows are in no cluster any more and are fetched as a refresh, where queue has the columns that say so: RESET.
    """
    hit = urls.join(datasets.select("dataset_id"), "dataset_id", "left_semi").select("dataset_url_id").distinct()
    rows = flagged(queue, hit, ["dataset_url_id"], "_hit").withColumn("_hit", F.col("_hit") & F.col("status").isin(*ENDED) & (F.col("fail_count") < 7))
    for name, value in RESET.items():
        if name in queue.columns:
            rows = rows.withColumn(name, F.when(F.col("_hit"), F.lit(value).cast(queue.schema[name].dataType)).otherwise(F.col(name)))
    return rows.select(*queue.columns)


def refresh_notices(datasets: DataFrame, refreshed_ids: DataFrame) -> DataFrame:
    """(user_id, dataset_id, type, message): what owners are told of refreshed datasets (dataset_id); each dataset once."""
    text = F.concat(F.lit('Dataset "'), F.coalesce("data_name", F.lit("")), F.lit('" has a new version ready.'))
    rows = datasets.where("user_id <> ''").join(refreshed_ids.select("dataset_id").distinct(), "dataset_id", "left_semi")
    return rows.select("user_id", "dataset_id", F.lit("refresh_complete").alias("type"), text.alias("message"))


def deleted(datasets: DataFrame, ids: DataFrame, urls: DataFrame, by_dataset: dict[str, DataFrame], by_url: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the datasets of ids and what belongs to them."""
    gone = urls.join(ids, "dataset_id", "left_semi").select("dataset_url_id")
    out = {"datasets": datasets.join(ids, "dataset_id", "left_anti"), "datasets_url": urls.join(ids, "dataset_id", "left_anti")}
    out |= {n: t.join(ids, "dataset_id", "left_anti") for n, t in by_dataset.items()}
    return out | {n: t.join(gone, "dataset_url_id", "left_anti") for n, t in by_url.items()}


def upserted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with new's rows in place of those of the same keys; of new's own repeats the last by its order of columns wins."""
    rest = [c for c in table.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return table.join(one, keys, "left_anti").select(*table.columns).unionByName(one.select(*table.columns))


def inserted(table: DataFrame, new: DataFrame, number: str, order: list[str]) -> DataFrame:
    """table with new's rows numbered on from its largest id. Numbers come from counts by file of the sorted rows, not from one ordered task."""
    last = table.agg(F.coalesce(F.max(number), F.lit(0))).scalar()
    rows = numbered(new, [F.col(c) for c in order]).withColumn(number, (last + F.col("_n") + 1).cast(table.schema[number].dataType))
    return table.unionByName(rows.select(*table.columns))


def unique_names(taken: DataFrame, wanted: DataFrame, name: str = "user_name", order: str = "user_id") -> DataFrame:
    """wanted with names made unique: name, name_1, name_2 and so on, the first free ones in order; names stay within a base's own series.

    A row's number is the i-th one that is not taken. Of the taken numbers of a base, sorted, the j-th stands behind t - j free ones; with the taken
    ones in between, each before the row that has as many free ones before it, that number is the row's place. Places come from counts of sorted
    files, so a base name that very many ask for spreads over tasks. A null name stays null; rows of one name differ in order.
    """
    bases = wanted.select(F.col(name).alias("_b")).where("_b IS NOT NULL").distinct()
    used = taken.select(F.col(name).alias("_u")).where("_u IS NOT NULL").distinct()
    series = used.select(F.regexp_extract("_u", r"(?s)^(.*)_([1-9]\d*)$", 1).alias("_b"), F.regexp_extract("_u", r"(?s)^(.*)_([1-9]\d*)$", 2).try_cast("bigint").alias("_t")).where("_t IS NOT NULL")
    held = series.unionByName(used.select(F.col("_u").alias("_b"), F.lit(0).cast("bigint").alias("_t"))).join(bases, "_b", "left_semi")
    before = placed(held, ["_b"], [F.col("_t")], "_j").select("_b", (F.col("_t") - F.col("_j")).alias("_i"), F.lit(None).cast(wanted.schema[order].dataType).alias("_o"), F.lit(False).alias("_asks"))
    asked = placed(wanted.where(F.col(name).isNotNull()).select(F.col(name).alias("_b"), F.col(order).alias("_o")), ["_b"], [F.col("_o")], "_i").withColumn("_asks", F.lit(True))
    numbers = placed(before.unionByName(asked.select(*before.columns)), ["_b"], [F.col("_i"), F.col("_asks")], "_k").where("_asks")
    given = numbers.select("_b", F.col("_o"), F.when(F.col("_k") == 0, F.col("_b")).otherwise(F.concat_ws("_", "_b", "_k")).alias("_u"))
    return wanted.join(given, (F.col(name) == F.col("_b")) & F.col(order).eqNullSafe(F.col("_o")), "left").withColumn(name, F.col("_u")).select(*wanted.columns)


def next_datasets(queue: DataFrame, status: str, most: int = 20) -> DataFrame:
    """(dataset_id): datasets with a row in that status, a worker's batch of them, those of least id."""
    return queue.where(F.col("status") == status).select("dataset_id").distinct().orderBy("dataset_id").limit(most)


# --- repairs ---------------------------------------------------------------------------------------------------


def _before(c: str, as_of: Column, seconds: int) -> Column:
    return F.coalesce(F.col(c) < as_of - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))


def stuck_locks(queue: DataFrame, as_of: Column) -> DataFrame:
    """Locks of half an hour and more on rows that have not ended are taken off."""
    hit = _before("locked_at", as_of, STUCK_LOCK_S) & ~F.col("status").isin(*ENDED)
    return queue.withColumn("locked_at", F.when(~hit, F.col("locked_at")))


def stuck_stages(queue: DataFrame, as_of: Column) -> DataFrame:
    """Rows two hours between stages start anew."""
    hit = F.col("status").isin("proceed-format", "proceed-extract", "proceed-version") & _before("created_at", as_of, STUCK_STAGE_S)
    return queue.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def stuck_fetches(queue: DataFrame, as_of: Column) -> DataFrame:
    """Rows half an hour in the fetching start anew, with an attempt less."""
    since = _before("locked_at", as_of, CRAWL_S) | (F.col("locked_at").isNull() & _before("created_at", as_of, CRAWL_S))
    rows = queue.withColumn("_hit", (F.col("status") == "crawling") & since)
    return rows.withColumn("status", F.when(F.col("_hit"), "pending").otherwise(F.col("status"))).withColumn("crawl_attempts", F.when(F.col("_hit"), F.greatest(F.col("crawl_attempts") - 1, F.lit(0))).otherwise(F.col("crawl_attempts"))).select(*queue.columns)


def raw_only(queue: DataFrame, files: DataFrame, amazon: DataFrame | None = None) -> DataFrame:
    """Done rows that have a raw page but nothing made of it have failed. files: (queue_id, raw, format, extract).

    amazon: (queue_id) of rows whose pages become entities at once; only those are looked at, and only for their entities.
    """
    rows = queue.join(files, "queue_id", "left")
    bare = F.coalesce(F.col("raw"), F.lit(False)) & ~F.coalesce(F.col("extract"), F.lit(False))
    if amazon is None:
        bare = bare & ~F.coalesce(F.col("format"), F.lit(False))
    else:
        rows = flagged(rows, amazon, ["queue_id"], "_amazon")
        bare = bare & F.col("_amazon")
    return rows.withColumn("status", F.when((F.col("status") == "done") & bare, "failed").otherwise(F.col("status"))).select(*queue.columns)


def without_orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """rows that have a parent."""
    return rows.join(parents.select(key), key, "left_semi")


def active_versions(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """datasets whose active version exists, or else is the last one, or none."""
    there = flagged(datasets.withColumn("version_number", F.col("active_version")), versions, ["dataset_id", "version_number"], "_there")
    last = versions.groupBy("dataset_id").agg(F.max("version_number").alias("_last"))
    rows = there.join(last, "dataset_id", "left")
    return rows.withColumn("active_version", F.when(F.col("_there") | F.col("active_version").isNull(), F.col("active_version")).otherwise(F.col("_last"))).select(*datasets.columns)


def missing_files(versions: DataFrame, listing: DataFrame) -> DataFrame:
    """One row (missing): versions whose file is not in listing (file_path)."""
    return versions.join(listing.select("file_path"), "file_path", "left_anti").agg(F.count("*").alias("missing"))


def counted(versions: DataFrame, stats: DataFrame) -> DataFrame:
    """versions with the counts of those that say 0 taken from their files. stats: (file_path, count)."""
    rows = versions.join(stats.select("file_path", F.col("count").alias("_c")), "file_path", "left")
    return rows.withColumn("entity_count", F.when(F.coalesce("entity_count", F.lit(0)) == 0, F.coalesce("_c", "entity_count")).otherwise(F.col("entity_count"))).select(*versions.columns)
