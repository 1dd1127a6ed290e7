"""Registered queries over versions, clusters and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import catalog as C
from weftline.operators import change, clusters, versions
from weftline.plans import build
from weftline.plans.tables import EDITED, ctes, d, edited_orders, t
from weftline.streaming.state import rate_limit

AS_OF = "TIMESTAMP '2024-06-15'"
#: Lines of documents, and of an edit of them.
_EDIT = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN concat(text, chr(10), 'one more line at the end', chr(10), 'http://new.com/', CAST(doc_id AS STRING)) WHEN 2 THEN substring(text, 1, 40) WHEN 3 THEN replace(text, ' the ', ' THE ') ELSE '' END"


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"), F.expr(_EDIT).alias("new"))


def d_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _edited(spark, sf_dir).select("doc_id", change.added(F.col("old"), F.col("new")).alias("a"), change.removed(F.col("old"), F.col("new")).alias("r"))
    return out.select("doc_id", F.array_join("a", "|").alias("added"), F.size("r").cast("bigint").alias("n_removed"))


def d_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.ladder(_edited(spark, sf_dir), with_links=F.col("doc_id") % 10 == 1, forced=F.col("doc_id") % 100 == 7).select("doc_id", "level", "proceed")


def d_version_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v1, v2 = edited_orders(spark, sf_dir)
    return versions.typed_changed(v1, v2, "id").unionByName(versions.typed_changed(v1, v1, "id"))


def d_posts_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select(F.col("page_id").alias("_ord"), "url")
    q = p.withColumn("url", F.when(F.col("_ord") == 7, "x").otherwise(F.col("url")))
    return versions.posts_changed(p, p).unionByName(versions.posts_changed(p, q))


def d_version_diff_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.typed_diff(*edited_orders(spark, sf_dir), ["id", "status", "priority", "cust"])


def d_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison, pairs included."""
    v1, v2 = (v.select(F.col("id").alias("_ord"), F.to_json(F.struct("id", "status", "priority", F.concat(F.lit("s"), (F.col("cust") % 50).cast("string")).alias("_source"))).alias("doc")) for v in edited_orders(spark, sf_dir))
    return versions.diff(v1, v2).select("change", "source", "v1", "v2", F.array_join("fields", ",").alias("fields"))


def d_field_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.typed_weights(t(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_mktsegment"])


def d_json_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.to_json(F.struct("p_name", "p_brand", "p_size", F.lit("s").alias("_source"))).alias("doc"))
    return versions.weights(rows)


def d_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v1, v2 = edited_orders(spark, sf_dir)
    return versions.typed_field_changes(v1, v2, ["id"], ["status", "priority", "cust"]).select("id", F.array_join("fields", ",").alias("fields"))


def v_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = d(spark, sf_dir, "versions"), d(spark, sf_dir, "datasets")
    one = v.groupBy("dataset_id", "version_number").agg(F.max("file_path").alias("file_path"), F.max("alt_file_path").alias("alt_file_path"))
    parts = [versions.resolve(one, s, w, a).withColumn("wanted", F.lit(f"{w}{'/alt' * a}")) for w, a in (("active", False), ("latest", False), ("v3", False), ("active", True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def v_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d(spark, sf_dir, "versions")
    new = v.where("dataset_id % 10 = 3").groupBy("dataset_id").agg((F.max("version_number") + 1).cast("int").alias("version_number")).select("dataset_id", "version_number", F.lit("new").alias("file_path"), F.lit(None).cast("string").alias("alt_file_path"), F.lit(1).cast("bigint").alias("entity_count"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(True).alias("is_active"))
    return versions.recorded(v, new).groupBy("dataset_id").agg(F.count("*").alias("n"), F.count_if("is_active").alias("n_active"), F.max("version_number").alias("last"))


def v_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = d(spark, sf_dir, "versions"), d(spark, sf_dir, "datasets")
    broken = v.where("dataset_id % 4 = 0 and version_number >= 4").select("dataset_id", "version_number").distinct()
    return versions.purged(v, s, broken)[1].select("dataset_id", "active_version")


def v_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset after the rollback of one."""
    return versions.rolled_back(d(spark, sf_dir, "datasets"), d(spark, sf_dir, "versions"), 5, 2, freeze=True).select("dataset_id", "active_version", "is_frozen")


def v_cloned(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, v, u = versions.cloned(d(spark, sf_dir, "datasets").withColumn("is_cloned", F.lit(False)).withColumn("cloned_from", F.lit(None).cast("bigint")), d(spark, sf_dir, "versions"), d(spark, sf_dir, "urls"), 4, 9_000_000, "u99")
    counts, last = u.groupBy("dataset_id").agg(F.count("*").alias("n_urls")), v.groupBy("dataset_id").agg(F.max("version_number").alias("version"))
    return s.select("dataset_id", "user_id", "clone_count", "is_cloned").join(counts, "dataset_id", "left").join(last, "dataset_id", "left")


def c_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d(spark, sf_dir, "crawl").unionByName(d(spark, sf_dir, "recrawl").where("queue_id % 3 = 1"))
    return clusters.crawl_clusters(rows).select("queue_id", "role", "primary")


def c_extract_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.extract_clusters(d(spark, sf_dir, "crawl").unionByName(d(spark, sf_dir, "recrawl"))).select("queue_id", "role", "primary")


def c_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters.crawl_clusters(d(spark, sf_dir, "crawl").unionByName(d(spark, sf_dir, "recrawl")))
    results = t(spark, sf_dir, "pages").where("page_id % 4 <> 0").select(F.col("page_id").alias("dataset_url_id"), F.length("html").cast("bigint").alias("result"))
    return clusters.fan_out(rows, results).select("queue_id", "role", "result")


def c_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.late_arrivals(d(spark, sf_dir, "crawl"), d(spark, sf_dir, "recrawl"))


def c_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.reusable(d(spark, sf_dir, "crawl"), d(spark, sf_dir, "recrawl").withColumn("url", F.expr("CASE WHEN dataset_url_id % 3 = 0 THEN rtrim('/', lower(url)) ELSE url END")))


def c_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters.crawl_clusters(d(spark, sf_dir, "crawl").unionByName(d(spark, sf_dir, "recrawl").withColumn("status", F.lit("pending")))).withColumn("crawl_attempts", F.lit(0))
    failed = rows.where("role = 'primary' and dataset_url_id % 3 = 0").select("queue_id", (F.col("dataset_url_id") % 2 + 2).cast("int").alias("attempts"))
    return clusters.failed_over(rows, failed).select("queue_id", "status", "role", "primary", "crawl_attempts")


def c_combine_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.ready(d(spark, sf_dir, "queue"), "dataset_url_id")


def c_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = d(spark, sf_dir, "crawl").withColumn("status", F.expr("CASE WHEN dataset_id = 3 AND queue_id % 20 = 6 THEN 'pending' WHEN queue_id % 4 = 0 THEN 'done' ELSE 'proceed-version' END"))
    extracts = t(spark, sf_dir, "pages").select((F.col("page_id") * 2).alias("queue_id"), F.col("url").alias("source_url"), F.expr("transform(sequence(0, int(page_id % 3)), i -> concat('{\"i\":', i, '}'))").alias("entities"))
    return versions.combined(q, extracts)


def r_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lambda n: d(spark, sf_dir, n)
    return C.market(g("datasets"), g("versions"), g("schemas"), g("subreddits"), F.expr(AS_OF))


def r_my_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lambda n: d(spark, sf_dir, n)
    return C.my_datasets(g("datasets"), g("versions"), g("schemas"), g("subreddits"), g("urls"), g("queue"), g("reddit_queue"))


#: Columns of the catalogue that only a dataset's page asks for.
_SCHEMA_FIELDS = """concat('{"name":"text","', lower(source), '":"', CAST(dataset_id AS STRING), '"}')"""
_INTENT = "CASE WHEN dataset_id % 3 = 0 THEN concat('find ', tag) END"
_FOLDER = "CASE WHEN dataset_url_id % 4 <> 0 THEN concat('raw/', CAST(dataset_url_id AS STRING)) END"


def _view(part: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = lambda n: d(spark, sf_dir, n)
        datasets = g("datasets").withColumn("intent", F.expr(_INTENT)).withColumn("extract_intent", F.lit(None).cast("string")).withColumn("is_cloned", F.col("dataset_id") % 10 == 1)
        schemas = g("schemas").where("dataset_id % 37 <> 0").withColumn("fields", F.expr(_SCHEMA_FIELDS))
        out = C.dataset_view(datasets, schemas, g("versions"), g("files"), g("urls").withColumn("folder_path", F.expr(_FOLDER)), g("queue"), g("reddit_queue"))[part]
        if part == "dataset":
            pairs = F.transform(F.array_sort(F.map_entries("schema")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
            out = out.withColumn("schema", F.array_join(pairs, ","))
        return out

    return query


#: Requests that users make: every order asks for its customer's dataset, some for others' or for none that there is.
_REQUESTS = "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 9 = 0 THEN 'u1' ELSE concat('u', CAST(c_nationkey AS STRING)) END AS user_id, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS dataset_id FROM orders JOIN customer ON o_custkey = c_custkey"


def r_refresh_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    asked = spark.sql(_REQUESTS.replace("FROM orders JOIN customer", "FROM {o} JOIN {c}"), o=o, c=c)
    return C.asked_by_users(asked, d(spark, sf_dir, "datasets"))


def r_refresh_pinged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a ping of its customer's dataset; a fifth of the datasets have no key."""
    datasets = d(spark, sf_dir, "datasets").withColumn("ping_key", F.expr("CASE WHEN dataset_id % 5 <> 0 THEN concat('k', CAST(dataset_id AS STRING)) END"))
    pings = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("ping_key"))
    return C.pinged(pings, datasets, d(spark, sf_dir, "users"))


def r_refresh_nightly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after the nightly refresh."""
    q = d(spark, sf_dir, "queue").withColumn("crawl_type", F.lit("first")).withColumn("primary", F.when(F.col("role") == "waiting", F.col("dataset_url_id") + 1))
    return C.refreshed(q, d(spark, sf_dir, "urls"), C.nightly(d(spark, sf_dir, "datasets"))).select("queue_id", "status", "crawl_type", "role", "primary")


def r_refresh_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = d(spark, sf_dir, "datasets")
    return C.refresh_notices(datasets, C.nightly(datasets))


def r_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.profile(d(spark, sf_dir, "datasets"), d(spark, sf_dir, "versions"))


def r_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.latest_status(d(spark, sf_dir, "urls"), (d(spark, sf_dir, "queue").where("dataset_url_id % 3 = 0"), "queue_id"), (d(spark, sf_dir, "reddit_queue"), "reddit_queue_id"))
    return out.select("dataset_url_id", "queue_status")


def r_versions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.versions_list(d(spark, sf_dir, "versions"))


def r_keepalive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.keepalive(("orders", t(spark, sf_dir, "orders"), "o_custkey"), ("part", t(spark, sf_dir, "part"), "p_size"))


def r_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batch(d(spark, sf_dir, "queue")).select("queue_id", "crawl_attempts")


def r_without_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without_open(d(spark, sf_dir, "datasets"), d(spark, sf_dir, "urls"), d(spark, sf_dir, "queue")).select("dataset_id")


def r_over_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.over_cap(d(spark, sf_dir, "datasets"), d(spark, sf_dir, "users")).select("dataset_id", "is_frozen", "nightly")


def r_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gates(d(spark, sf_dir, "datasets"), d(spark, sf_dir, "users"), d(spark, sf_dir, "urls"))


def r_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.expired(d(spark, sf_dir, "users"), F.expr(AS_OF))


def r_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.refreshed(d(spark, sf_dir, "queue"), d(spark, sf_dir, "urls"), d(spark, sf_dir, "datasets").where("nightly")).groupBy("status").agg(F.count("*").alias("n"))


def r_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = d(spark, sf_dir, "datasets").where("dataset_id % 3 = 0").select("dataset_id")
    left = C.deleted(d(spark, sf_dir, "datasets"), ids, d(spark, sf_dir, "urls"), {"versions": d(spark, sf_dir, "versions")}, {"queue": d(spark, sf_dir, "queue")})
    parts = [x.agg(F.count("*").alias("n")).withColumn("name", F.lit(k)) for k, x in sorted(left.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def r_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = d(spark, sf_dir, "users").select("user_id", "plan")
    new = u.where("plan = 'free'").select("user_id", F.lit("starter").alias("plan")).unionByName(spark.range(1).selectExpr("'u77' AS user_id", "'free' AS plan"))
    return C.upserted(u, new, ["user_id"])


def r_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return C.inserted(n, t(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "id", ["name"])


def r_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for all customers, a fifth of them for each base name."""
    taken = spark.range(1).selectExpr("explode(array('AUTOMOBILE', 'BUILDING_1')) AS user_name")
    return C.unique_names(taken, t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("user_name"), F.col("c_custkey").alias("user_id")))


def _queue(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = d(spark, sf_dir, "queue").withColumn("created_at", F.expr("created_at + make_interval(30)")).withColumn("locked_at", F.expr("locked_at + make_interval(30)"))
        return f(q, F.expr(AS_OF))

    return query


def x_raw_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = d(spark, sf_dir, "queue")
    files = q.select("queue_id", (F.col("queue_id") % 2 == 0).alias("raw"), (F.col("queue_id") % 3 == 0).alias("format"), (F.col("queue_id") % 5 == 0).alias("extract")).distinct()
    a = C.raw_only(q, files).groupBy("status").agg(F.count("*").alias("n"))
    b = C.raw_only(q, files, q.where("dataset_id % 2 = 0").select("queue_id")).groupBy("status").agg(F.count("*").alias("n"))
    return a.withColumn("which", F.lit("raw")).unionByName(b.withColumn("which", F.lit("amazon")))


def x_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = C.without_orphans(d(spark, sf_dir, "urls"), d(spark, sf_dir, "datasets").where("dataset_id > 100"), "dataset_id")
    return C.without_orphans(d(spark, sf_dir, "queue"), u, "dataset_url_id").select("queue_id")


def x_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.active_versions(d(spark, sf_dir, "datasets"), d(spark, sf_dir, "versions")).select("dataset_id", "active_version")


def x_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_files(d(spark, sf_dir, "versions"), d(spark, sf_dir, "versions").where("entity_count > 0").select("file_path"))


def x_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d(spark, sf_dir, "versions")
    stats = v.where("version_number < 4").select("file_path", F.lit(11).cast("bigint").alias("count"))
    return C.counted(v, stats).select("file_path", "entity_count")


def w_rate_limit_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as requests of one key, which is spread over tasks: its requests are more than a task shall read in order."""
    rows = t(spark, sf_dir, "events").select("event_id", F.lit("all").alias("key"), "ts")
    return rate_limit(rows, "key", "ts", "event_id", limit=5, window=3600.0, most=1000).select("event_id", "allowed", "remaining", F.round("retry_after", 3).alias("retry_after"))


def w_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day from a user's first event, three events each."""
    return rate_limit(t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", limit=3, window=86_400.0).select("event_id", "allowed", "remaining")


def b_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on their way to the model: cleaned, compressed, cut into chunks."""
    return build.chunked(build.formatted(build.cleaned(t(spark, sf_dir, "pages"))))


QUERIES = {
    "b_build": b_build, "d_lines": d_lines, "d_ladder": d_ladder, "d_version_changed": d_version_changed, "d_posts_changed": d_posts_changed, "d_version_diff_exact": d_version_diff_exact, "d_version_diff": d_version_diff,
    "d_field_weights": d_field_weights, "d_json_weights": d_json_weights, "d_changed_fields": d_changed_fields, "v_resolve": v_resolve, "v_recorded": v_recorded, "v_purged": v_purged, "v_rolled_back": v_rolled_back,
    "v_cloned": v_cloned, "c_cluster": c_cluster, "c_extract_cluster": c_extract_cluster, "c_fanout": c_fanout, "c_late": c_late, "c_reuse": c_reuse, "c_failover": c_failover, "c_combine_ready": c_combine_ready,
    "c_combined": c_combined, "r_market": r_market, "r_my_datasets": r_my_datasets, "r_profile": r_profile, "r_latest_status": r_latest_status, "r_versions_list": r_versions_list, "r_keepalive": r_keepalive,
    "r_batch": r_batch, "r_without_open": r_without_open, "r_over_cap": r_over_cap, "r_gates": r_gates, "r_expiry": r_expiry, "r_refresh": r_refresh, "r_delete": r_delete, "r_upsert": r_upsert, "r_insert": r_insert,
    "r_dataset_view": _view("dataset"), "r_dataset_versions": _view("versions"), "r_dataset_urls": _view("urls"), "r_refresh_asked": r_refresh_asked, "r_refresh_pinged": r_refresh_pinged,
    "r_refresh_nightly": r_refresh_nightly, "r_refresh_notices": r_refresh_notices,
    "r_unique_names": r_unique_names, "x_stuck_locks": _queue(lambda q, a: C.stuck_locks(q, a).select("queue_id", "locked_at")), "x_stuck_stages": _queue(lambda q, a: C.stuck_stages(q, a).select("queue_id", "status")),
    "x_stuck_fetches": _queue(lambda q, a: C.stuck_fetches(q, a).select("queue_id", "status", "crawl_attempts")), "x_raw_only": x_raw_only, "x_orphans": x_orphans, "x_active": x_active, "x_missing": x_missing,
    "x_counted": x_counted, "w_rate_limit": w_rate_limit, "w_rate_limit_one_key": w_rate_limit_one_key,
}


# --- SQL -------------------------------------------------------------------------------------------------------

_WS = r"[\s\x0B\x{85}\x{A0}]+"
_LINES = lambda c: f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^[^0-9A-Za-z_]+$'))"
_N = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: len(list_filter(regexp_split_to_array(x, '{_WS}'), lambda y: y <> '')))), 0)"
_DOCS = f"l AS (SELECT doc_id, old, new, {_LINES('old')} AS lo, {_LINES('new')} AS ln FROM (SELECT doc_id, text AS old, {_EDIT} AS new FROM documents)), a AS (SELECT *, list_filter(ln, lambda x: NOT list_contains(lo, x)) AS added, list_filter(lo, lambda x: NOT list_contains(ln, x)) AS removed FROM l)"
_URLS = lambda c: f"list_filter({c}, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://'))"
_LADDER = (
    f"WITH {_DOCS}, m AS (SELECT *, {_N('lo')} AS stored, {_N('ln')} AS incoming, {_N('added')} + {_N('removed')} AS delta FROM a), g AS (SELECT *, CASE WHEN doc_id % 100 = 7 THEN 'forced' WHEN new = '' THEN 'empty' WHEN doc_id % 10 = 1 THEN 'urls' "
    "WHEN old <> '' AND old = new THEN 'same' WHEN stored > 0 AND incoming / stored < 0.27 THEN 'bad_fetch' WHEN stored > 0 AND delta / stored < 0.02 THEN 'too_little' WHEN stored > 0 AND delta / stored >= 0.15 THEN 'enough' ELSE 'gray' END AS level FROM m) "
    f"SELECT doc_id, level, CASE level WHEN 'urls' THEN len(list_filter({_URLS('ln')}, lambda x: NOT list_contains({_URLS('lo')}, x))) > 0 WHEN 'gray' THEN true ELSE level IN ('forced', 'enough') END AS proceed FROM g"
)
_BOTH = "b AS (SELECT * FROM crawl UNION ALL SELECT * FROM recrawl)"
_CRAWL = ctes("crawl", "recrawl") + ", "
_ROLE = "CASE WHEN count(*) OVER w = 1 THEN 'solo' WHEN row_number() OVER (PARTITION BY {k} ORDER BY queue_id) = 1 THEN 'primary' ELSE 'waiting' END AS role, first_value({t}) OVER (PARTITION BY {k} ORDER BY queue_id) AS lead"
_NORM = "regexp_replace(trim(lower(url)), '/+$', '')"
_CLUSTER = "k AS (SELECT *, " + _ROLE.format(k=_NORM, t="dataset_url_id") + f" FROM {{src}} WINDOW w AS (PARTITION BY {_NORM}))"
_LIMIT = "CASE WHEN plan = 'starter' THEN {0} ELSE {1} END"
_SHIFT = "q AS (SELECT * REPLACE (created_at + INTERVAL 30 YEAR AS created_at, locked_at + INTERVAL 30 YEAR AS locked_at) FROM queue)"
_KIND = "CASE WHEN dataset_type = 'amazon' THEN 'amazon' WHEN dataset_id IN (SELECT dataset_id FROM subreddits) OR dataset_id IN (SELECT dataset_id FROM schemas WHERE source = 'reddit') THEN 'reddit' ELSE 'web' END"
_ACTIVE = "act AS (SELECT v.dataset_id, max(entity_count) AS entity_count, bool_or(coalesce(alt_file_path, '') <> '') AS has_alt, max(v.created_at) AS refreshed FROM versions v JOIN datasets s ON s.dataset_id = v.dataset_id AND s.active_version = v.version_number GROUP BY v.dataset_id)"
_LATEST = "coalesce(lq.s, lr.s, 'pending')"
_LATEST_JOIN = "LEFT JOIN (SELECT dataset_url_id, max_by(status, queue_id) AS s FROM queue GROUP BY 1) lq USING (dataset_url_id) LEFT JOIN (SELECT dataset_url_id, max_by(status, reddit_queue_id) AS s FROM reddit_queue GROUP BY 1) lr USING (dataset_url_id)"
_OPEN = "SELECT u.dataset_id FROM queue q JOIN urls u USING (dataset_url_id) WHERE q.status NOT IN ('done', 'failed')"

ORACLE_SQL = {
    "d_lines": f"WITH {_DOCS} SELECT doc_id, array_to_string(added, '|') AS added, len(removed) AS n_removed FROM a",
    "d_ladder": _LADDER,
    "d_version_changed": EDITED + " SELECT count(*) > 0 AS changed FROM v1 FULL JOIN v2 USING (id) WHERE (v1.status, v1.priority, v1.cust) IS DISTINCT FROM (v2.status, v2.priority, v2.cust) UNION ALL SELECT false",
    "d_posts_changed": "SELECT false AS changed UNION ALL SELECT count(*) > 0 FROM pages WHERE page_id = 7 AND url <> 'x'",
    # Status and priority together are too light to pair by, so pairs share their id.
    "d_version_diff": EDITED + """, e AS (SELECT *, 1 AS side FROM v1 UNION ALL SELECT *, 2 FROM v2),
f AS (SELECT side, id, concat('s', cust % 50) AS source, concat('{"_source":"s', cust % 50, '","id":', id, ',"priority":"', priority, '","status":"', status, '"}') AS v FROM e),
a AS (SELECT id, source, v AS v1 FROM f WHERE side = 1), b AS (SELECT id, source, v AS v2 FROM f WHERE side = 2)
SELECT CASE WHEN v2 IS NULL THEN 'subtracted' WHEN v1 IS NULL THEN 'added' ELSE 'modified' END AS change, source, v1, v2, CASE WHEN v1 IS NULL OR v2 IS NULL THEN '' ELSE 'status' END AS fields
FROM a FULL JOIN b USING (id, source) WHERE v1 IS DISTINCT FROM v2""",
    "d_version_diff_exact": EDITED + " SELECT id, status, priority, cust, CAST(min(side) AS INT) AS side FROM (SELECT *, 1 AS side FROM v1 UNION ALL SELECT *, 2 FROM v2) GROUP BY id, status, priority, cust HAVING min(side) = max(side)",
    "d_field_weights": "SELECT 'c_custkey' AS field, count(DISTINCT c_custkey) / count(*) AS weight FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) / count(*) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) / count(*) FROM customer",
    "d_json_weights": "SELECT 'p_name' AS field, count(DISTINCT p_name) / count(*) AS weight FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) / count(*) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) / count(*) FROM part",
    "d_changed_fields": EDITED + " SELECT id, 'status' AS fields FROM v1 JOIN v2 USING (id) WHERE v1.status <> v2.status",
    "v_resolve": ctes("versions", "datasets") + ", one AS (SELECT dataset_id, version_number, max(file_path) AS file_path, max(alt_file_path) AS alt FROM versions GROUP BY ALL), act AS (SELECT one.* FROM one JOIN datasets s ON s.dataset_id = one.dataset_id AND s.active_version = one.version_number) SELECT dataset_id, version_number, file_path AS path, 'active' AS wanted FROM act UNION ALL SELECT dataset_id, version_number, alt, 'active/alt' FROM act WHERE trim(coalesce(alt, '')) <> '' UNION ALL SELECT dataset_id, version_number, file_path, 'v3' FROM one WHERE version_number = 3 UNION ALL SELECT dataset_id, version_number, file_path, 'latest' FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY version_number DESC) AS r FROM one) WHERE r = 1",
    "v_recorded": ctes("versions") + " SELECT dataset_id, n + CASE WHEN dataset_id % 10 = 3 THEN 1 ELSE 0 END AS n, CASE WHEN dataset_id % 10 = 3 THEN 1 ELSE act END AS n_active, CAST(last + CASE WHEN dataset_id % 10 = 3 THEN 1 ELSE 0 END AS INT) AS last FROM (SELECT dataset_id, count(*) AS n, count(*) FILTER (is_active) AS act, max(version_number) AS last FROM versions GROUP BY dataset_id)",
    "v_purged": ctes("versions", "datasets") + " SELECT dataset_id, CAST(CASE WHEN hit THEN coalesce(last, 0) ELSE active_version END AS INT) AS active_version FROM datasets LEFT JOIN (SELECT dataset_id, bool_or(dataset_id % 4 = 0 AND version_number >= 4) AS hit, max(CASE WHEN NOT (dataset_id % 4 = 0 AND version_number >= 4) THEN version_number END) AS last FROM versions GROUP BY dataset_id) USING (dataset_id)",
    "v_cloned": ctes("datasets", "versions", "urls") + ", s AS (SELECT dataset_id, user_id, clone_count + CASE WHEN dataset_id = 4 THEN 1 ELSE 0 END AS clone_count, false AS is_cloned FROM datasets UNION ALL SELECT 9000000, 'u99', 0, true FROM datasets WHERE dataset_id = 4), n AS (SELECT dataset_id, count(*) AS n_urls FROM (SELECT dataset_id FROM urls UNION ALL SELECT 9000000 FROM urls WHERE dataset_id = 4) GROUP BY dataset_id), v AS (SELECT dataset_id, max(version_number) AS version FROM versions GROUP BY dataset_id UNION ALL SELECT DISTINCT 9000000, 1 FROM versions WHERE dataset_id = 4) SELECT * FROM s LEFT JOIN n USING (dataset_id) LEFT JOIN v USING (dataset_id)",
    "c_cluster": _CRAWL + "b AS (SELECT * FROM crawl UNION ALL SELECT * FROM recrawl WHERE queue_id % 3 = 1), " + _CLUSTER.format(src="b") + " SELECT queue_id, role, CASE WHEN role = 'waiting' THEN lead END AS primary FROM k",
    "c_extract_cluster": _CRAWL + _BOTH + ", k AS (SELECT *, " + _ROLE.format(k=f"schema_hash, {_NORM}", t="queue_id") + f" FROM b WINDOW w AS (PARTITION BY schema_hash, {_NORM})) SELECT queue_id, role, CASE WHEN role = 'waiting' THEN lead END AS primary FROM k",
    "c_fanout": _CRAWL + _BOTH + ", " + _CLUSTER.format(src="b") + ", r AS (SELECT page_id, length(html) AS result FROM pages WHERE page_id % 4 <> 0) SELECT queue_id, CASE WHEN role = 'waiting' AND result IS NOT NULL THEN 'solo' ELSE role END AS role, result FROM k LEFT JOIN r ON page_id = CASE WHEN role = 'waiting' THEN lead ELSE dataset_url_id END",
    "c_late": _CRAWL + f"a AS (SELECT *, {_NORM} AS n FROM crawl), z AS (SELECT *, {_NORM} AS n FROM recrawl) SELECT a.queue_id, min(z.queue_id) AS from_queue_id FROM a JOIN z USING (schema_hash, n) WHERE a.dataset_id <> z.dataset_id GROUP BY a.queue_id",
    "c_reuse": _CRAWL + "z AS (SELECT * REPLACE (CASE WHEN dataset_url_id % 3 = 0 THEN rtrim(lower(url), '/') ELSE url END AS url) FROM recrawl) SELECT a.queue_id, min(z.queue_id) AS from_queue_id FROM crawl a JOIN z USING (schema_hash, url) WHERE a.dataset_id <> z.dataset_id GROUP BY a.queue_id",
    "c_failover": _CRAWL + _BOTH + ", " + _CLUSTER.format(src="b") + ", f AS (SELECT dataset_url_id AS lead_id, CAST(dataset_url_id % 2 + 2 AS INT) AS attempts FROM k WHERE role = 'primary' AND dataset_url_id % 3 = 0), h AS (SELECT lead, min(queue_id) AS heir FROM k WHERE role = 'waiting' GROUP BY lead), hu AS (SELECT h.lead, heir, dataset_url_id AS heir_url FROM h JOIN k ON queue_id = heir) SELECT queue_id, CASE WHEN role = 'primary' AND dataset_url_id IN (SELECT lead_id FROM f) THEN 'failed' WHEN role = 'waiting' AND attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN role = 'waiting' AND attempts < 3 AND queue_id = heir THEN 'primary' ELSE role END AS role, CASE WHEN role <> 'waiting' THEN NULL WHEN attempts < 3 THEN CASE WHEN queue_id <> heir THEN heir_url END ELSE k.lead END AS primary, CASE WHEN role = 'waiting' AND attempts < 3 AND queue_id = heir THEN attempts ELSE 0 END AS crawl_attempts FROM k LEFT JOIN f ON role = 'waiting' AND lead_id = k.lead LEFT JOIN hu ON hu.lead = k.lead",
    "c_combine_ready": ctes("queue") + " SELECT dataset_url_id FROM queue GROUP BY dataset_url_id HAVING bool_and(status IN ('done', 'failed', 'proceed-version'))",
    "c_combined": ctes("crawl") + ", q AS (SELECT *, CASE WHEN dataset_id = 3 AND queue_id % 20 = 6 THEN 'pending' WHEN queue_id % 4 = 0 THEN 'done' ELSE 'proceed-version' END AS st FROM crawl), e AS (SELECT dataset_id, queue_id, url, unnest(range(page_id % 3 + 1)) AS i FROM q JOIN (SELECT page_id FROM pages) ON page_id * 2 = queue_id WHERE st = 'proceed-version' AND dataset_id NOT IN (SELECT dataset_id FROM q WHERE st = 'pending')) SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY queue_id, i) - 1 AS _ord, concat('{\"_source\":\"', replace(url, '&', '\\u0026'), '\",\"i\":', i, '}') AS doc FROM e",
    "r_market": ctes("datasets", "versions", "schemas", "subreddits") + f", {_ACTIVE} SELECT dataset_id, data_name, coalesce(alias, data_name) AS alias, coalesce(description, '') AS description, coalesce(tag, '') AS tag, is_premium, price, clone_count, api_hit_count, active_version, created_at, {_KIND} AS dataset_type, coalesce(has_alt, false) AS has_alt, coalesce(entity_count, 0) AS entity_count, CAST(clone_count * 3 + api_hit_count - date_diff('day', created_at, {AS_OF}) * 0.5 AS DOUBLE) AS rank FROM datasets LEFT JOIN act USING (dataset_id) WHERE visibility = 'public' AND active_version IS NOT NULL AND dataset_id IN (SELECT dataset_id FROM versions)",
    "r_my_datasets": ctes("datasets", "versions", "schemas", "subreddits", "urls", "queue", "reddit_queue") + f", {_ACTIVE}, vl AS (SELECT dataset_id, string_agg(CAST(version_number AS VARCHAR), ',' ORDER BY version_number DESC) AS versions FROM versions GROUP BY dataset_id), o AS ({_OPEN} UNION {_OPEN.replace('queue q', 'reddit_queue q')}) SELECT dataset_id, user_id, coalesce(nullif(trim(alias), ''), data_name) AS name, coalesce(refreshed, created_at) AS last_refresh, coalesce(entity_count, 0) AS entity_count, coalesce(versions, '') AS versions, {_KIND} AS source, coalesce(has_alt, false) AS has_alt, CASE WHEN is_frozen THEN 'frozen' WHEN dataset_id IN (SELECT dataset_id FROM o) OR versions IS NULL THEN 'processing' ELSE 'active' END AS status, created_at FROM datasets LEFT JOIN act USING (dataset_id) LEFT JOIN vl USING (dataset_id)",
    "r_dataset_view": ctes("datasets", "versions", "schemas", "files", "urls", "queue", "reddit_queue") + f""", st AS (SELECT u.*, {_LATEST} AS st FROM urls u {_LATEST_JOIN}),
op AS (SELECT DISTINCT dataset_id FROM st WHERE st NOT IN ('done', 'failed')), la AS (SELECT dataset_id, arg_max(created_at, (version_number, file_path)) AS last FROM versions GROUP BY dataset_id),
ac AS (SELECT s.dataset_id, arg_min({{'e': v.entity_count, 'b': coalesce(f.bytes, 0)}}, v.file_path) AS a FROM datasets s JOIN versions v ON v.dataset_id = s.dataset_id AND v.version_number = s.active_version LEFT JOIN files f USING (file_path) GROUP BY s.dataset_id)
SELECT s.dataset_id, user_id, data_name AS name, coalesce(description, '') AS description, coalesce({_INTENT}, '') AS intent, '' AS extract_intent, coalesce(tag, '') AS tag, visibility, is_frozen, dataset_id % 10 = 1 AS is_cloned, nightly,
CASE WHEN is_frozen THEN 'frozen' WHEN dataset_id IN (FROM op) THEN 'processing' ELSE 'active' END AS status, coalesce(active_version, 0) AS active_version, created_at, coalesce(last, created_at) AS last_refresh,
CASE WHEN dataset_id % 37 <> 0 THEN concat('name=text,', source, '=', dataset_id) END AS schema, coalesce(a.e, 0) AS entity_count, coalesce(a.b, 0) AS file_size_bytes, dataset_type
FROM datasets s LEFT JOIN schemas USING (dataset_id) LEFT JOIN la USING (dataset_id) LEFT JOIN ac USING (dataset_id)""",
    "r_dataset_versions": ctes("datasets", "versions", "files") + " SELECT dataset_id, version_number, file_path, nullif(alt_file_path, '') AS alt_file_path, created_at, is_active, entity_count, coalesce(bytes, 0) AS file_size_bytes FROM versions LEFT JOIN files USING (file_path) WHERE dataset_id IN (SELECT dataset_id FROM datasets)",
    "r_dataset_urls": ctes("datasets", "urls", "queue", "reddit_queue") + f" SELECT u.dataset_id, u.dataset_url_id, u.url, u.source_type, {_LATEST} AS queue_status, CASE WHEN u.dataset_url_id % 4 <> 0 THEN concat('raw/', u.dataset_url_id) END AS folder_path FROM urls u {_LATEST_JOIN} WHERE u.dataset_id IN (SELECT dataset_id FROM datasets)",
    "r_refresh_asked": ctes("datasets") + f", q AS ({_REQUESTS}), e AS (SELECT q.*, CASE WHEN s.dataset_id IS NULL THEN 'not found' WHEN s.user_id <> q.user_id THEN 'forbidden' WHEN is_frozen THEN 'dataset is frozen' END AS error FROM q LEFT JOIN datasets s ON s.dataset_id = q.dataset_id) SELECT request_id, user_id, dataset_id, CASE WHEN error IS NULL THEN 'queued' ELSE 'error' END AS status, error FROM e",
    "r_refresh_pinged": ctes("datasets", "users") + ", e AS (SELECT o_orderkey AS request_id, concat('k', o_custkey) AS ping_key, s.dataset_id, CASE WHEN s.dataset_id IS NULL THEN 'invalid ping key' WHEN coalesce(plan, 'free') <> 'starter' THEN 'plan' WHEN is_frozen THEN 'dataset is frozen' END AS error FROM orders LEFT JOIN datasets s ON s.dataset_id = o_custkey AND s.dataset_id % 5 <> 0 LEFT JOIN users USING (user_id)) SELECT request_id, ping_key, CASE WHEN error IS NULL THEN dataset_id END AS dataset_id, CASE WHEN error IS NULL THEN 'queued' ELSE 'error' END AS status, error FROM e",
    "r_refresh_nightly": ctes("queue", "urls", "datasets") + ", h AS (SELECT *, status IN ('done', 'failed') AND fail_count < 7 AND dataset_url_id IN (SELECT dataset_url_id FROM urls JOIN datasets USING (dataset_id) WHERE nightly AND NOT is_frozen) AS hit FROM queue) SELECT queue_id, CASE WHEN hit THEN 'pending-diff' ELSE status END AS status, CASE WHEN hit THEN 'nightly-recrawl' ELSE 'first' END AS crawl_type, CASE WHEN hit THEN 'solo' ELSE role END AS role, CASE WHEN role = 'waiting' AND NOT hit THEN dataset_url_id + 1 END AS primary FROM h",
    "r_refresh_notices": ctes("datasets") + " SELECT user_id, dataset_id, 'refresh_complete' AS type, concat('Dataset \"', data_name, '\" has a new version ready.') AS message FROM datasets WHERE nightly AND NOT is_frozen",
    "r_profile": ctes("datasets", "versions") + " SELECT user_id, count(*) FILTER (visibility = 'public') AS public_datasets, CAST(sum(clone_count) AS BIGINT) AS clones, CAST(sum(api_hit_count) AS BIGINT) AS api_hits, CAST(coalesce(sum(n), 0) AS BIGINT) AS versions FROM datasets LEFT JOIN (SELECT dataset_id, count(*) AS n FROM versions GROUP BY dataset_id) USING (dataset_id) GROUP BY user_id",
    "r_latest_status": ctes("urls", "queue", "reddit_queue") + " SELECT dataset_url_id, coalesce((SELECT max_by(status, queue_id) FROM queue q WHERE q.dataset_url_id = urls.dataset_url_id AND q.dataset_url_id % 3 = 0), (SELECT max_by(status, reddit_queue_id) FROM reddit_queue r WHERE r.dataset_url_id = urls.dataset_url_id), 'pending') AS queue_status FROM urls",
    "r_versions_list": ctes("versions") + " SELECT dataset_id, string_agg(CAST(version_number AS VARCHAR), ',' ORDER BY version_number DESC) AS versions FROM versions GROUP BY dataset_id",
    "r_keepalive": "SELECT * FROM (SELECT count(*) AS orders_rows, count(DISTINCT o_custkey) AS orders_distinct, max(o_custkey) AS orders_last FROM orders), (SELECT count(*) AS part_rows, count(DISTINCT p_size) AS part_distinct, max(p_size) AS part_last FROM part)",
    "r_batch": ctes("queue") + " SELECT queue_id, crawl_attempts FROM queue JOIN (SELECT dataset_id, count(*) AS n FROM queue GROUP BY dataset_id) USING (dataset_id) WHERE status = 'pending' AND role <> 'waiting' AND crawl_attempts < 3 ORDER BY crawl_attempts, n, created_at, queue_id LIMIT 20",
    "r_without_open": ctes("datasets", "urls", "queue") + f" SELECT dataset_id FROM datasets WHERE dataset_id NOT IN ({_OPEN})",
    "r_over_cap": ctes("datasets", "users") + f" SELECT dataset_id, is_frozen OR over AS is_frozen, nightly AND NOT over AS nightly FROM (SELECT datasets.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at, dataset_id) > {_LIMIT.format(5, 1)} AS over FROM datasets LEFT JOIN users USING (user_id))",
    "r_gates": ctes("datasets", "users", "urls") + f" SELECT dataset_id, coalesce(n, 0) AS urls, CAST({_LIMIT.format(100, 20)} AS INT) AS url_limit, greatest({_LIMIT.format(100, 20)} - coalesce(n, 0), 0) AS url_room, coalesce(s, 0) AS serp, CAST({_LIMIT.format(40, 10)} AS INT) AS serp_limit FROM datasets LEFT JOIN users USING (user_id) LEFT JOIN (SELECT dataset_id, count(*) AS n, count(*) FILTER (source_type = 'serp') AS s FROM urls WHERE url_type <> 'discovery' GROUP BY dataset_id) USING (dataset_id)",
    "r_expiry": ctes("users") + f" SELECT user_id, user_name, CASE WHEN e THEN coalesce(pending_plan, 'free') ELSE plan END AS plan, CASE WHEN NOT e THEN pending_plan END AS pending_plan, CASE WHEN NOT e THEN plan_expires_at END AS plan_expires_at FROM (SELECT *, plan <> 'free' AND plan_expires_at <= {AS_OF} AS e FROM users)",
    "r_refresh": ctes("queue", "urls", "datasets") + " SELECT CASE WHEN status IN ('done', 'failed') AND fail_count < 7 AND dataset_url_id IN (SELECT dataset_url_id FROM urls JOIN datasets USING (dataset_id) WHERE nightly) THEN 'pending-diff' ELSE status END AS status, count(*) AS n FROM queue GROUP BY 1",
    "r_delete": ctes("datasets", "urls", "versions", "queue") + ", i AS (SELECT dataset_id FROM datasets WHERE dataset_id % 3 = 0) SELECT 'datasets' AS name, count(*) AS n FROM datasets WHERE dataset_id NOT IN (FROM i) UNION ALL SELECT 'datasets_url', count(*) FROM urls WHERE dataset_id NOT IN (FROM i) UNION ALL SELECT 'versions', count(*) FROM versions WHERE dataset_id NOT IN (FROM i) UNION ALL SELECT 'queue', count(*) FROM queue WHERE dataset_url_id NOT IN (SELECT dataset_url_id FROM urls WHERE dataset_id IN (FROM i))",
    "r_upsert": ctes("users") + " SELECT user_id, 'starter' AS plan FROM users UNION ALL SELECT 'u77', 'free'",
    "r_insert": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name), r_name FROM region",
    "v_rolled_back": ctes("versions", "datasets") + " SELECT dataset_id, CAST(CASE WHEN h THEN 2 ELSE active_version END AS INT) AS active_version, CASE WHEN h THEN true ELSE is_frozen END AS is_frozen FROM (SELECT *, dataset_id = 5 AND EXISTS (SELECT 1 FROM versions v WHERE v.dataset_id = 5 AND version_number = 2) AS h FROM datasets)",
    "r_unique_names": "SELECT user_id, CASE WHEN k = 0 THEN seg ELSE concat(seg, '_', k) END AS user_name FROM (SELECT c_custkey AS user_id, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer) JOIN (SELECT seg, k, row_number() OVER (PARTITION BY seg ORDER BY k) AS i FROM (SELECT seg, unnest(range(n + 2)) AS k FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment)) WHERE NOT (seg = 'AUTOMOBILE' AND k = 0) AND NOT (seg = 'BUILDING' AND k = 1)) USING (seg, i)",
    "x_stuck_locks": ctes("queue") + f", {_SHIFT} SELECT queue_id, CASE WHEN locked_at < {AS_OF} - INTERVAL 30 MINUTE AND status NOT IN ('done', 'failed') THEN NULL ELSE locked_at END AS locked_at FROM q",
    "x_stuck_stages": ctes("queue") + f", {_SHIFT} SELECT queue_id, CASE WHEN status IN ('proceed-format', 'proceed-extract', 'proceed-version') AND created_at < {AS_OF} - INTERVAL 2 HOUR THEN 'pending' ELSE status END AS status FROM q",
    "x_stuck_fetches": ctes("queue") + f", {_SHIFT}, h AS (SELECT *, status = 'crawling' AND coalesce(locked_at, created_at) < {AS_OF} - INTERVAL 30 MINUTE AS hit FROM q) SELECT queue_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CAST(CASE WHEN hit THEN greatest(crawl_attempts - 1, 0) ELSE crawl_attempts END AS INT) AS crawl_attempts FROM h",
    "x_raw_only": ctes("queue") + " SELECT CASE WHEN status = 'done' AND queue_id % 2 = 0 AND queue_id % 3 <> 0 AND queue_id % 5 <> 0 THEN 'failed' ELSE status END AS status, count(*) AS n, 'raw' AS which FROM queue GROUP BY 1 UNION ALL SELECT CASE WHEN status = 'done' AND queue_id % 2 = 0 AND queue_id % 5 <> 0 AND dataset_id % 2 = 0 THEN 'failed' ELSE status END, count(*), 'amazon' FROM queue GROUP BY 1",
    "x_orphans": ctes("queue", "urls", "datasets") + " SELECT queue_id FROM queue WHERE dataset_url_id IN (SELECT dataset_url_id FROM urls WHERE dataset_id IN (SELECT dataset_id FROM datasets WHERE dataset_id > 100))",
    "x_active": ctes("datasets", "versions") + " SELECT dataset_id, CAST(CASE WHEN active_version IS NULL OR EXISTS (SELECT 1 FROM versions v WHERE v.dataset_id = s.dataset_id AND v.version_number = s.active_version) THEN active_version ELSE (SELECT max(version_number) FROM versions v WHERE v.dataset_id = s.dataset_id) END AS INT) AS active_version FROM datasets s",
    "x_missing": ctes("versions") + " SELECT count(*) AS missing FROM versions WHERE entity_count = 0",
    "w_rate_limit_one_key": """WITH RECURSIVE e AS (SELECT event_id, ts, epoch_us(ts) AS u FROM events), p AS (SELECT DISTINCT u FROM e),
nxt AS (SELECT u, min(u) OVER (ORDER BY u RANGE BETWEEN 3600000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS v FROM p),
s AS (SELECT min(u) AS u FROM p UNION ALL SELECT nxt.v FROM s JOIN nxt USING (u) WHERE nxt.v IS NOT NULL),
w AS (SELECT e.*, max(s.u) OVER (ORDER BY e.u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM e LEFT JOIN s USING (u)),
r AS (SELECT event_id, u - b AS since, row_number() OVER (PARTITION BY b ORDER BY ts, event_id) - 1 AS i FROM w)
SELECT event_id, i < 5 AS allowed, CAST(greatest(4 - i, 0) AS INT) AS remaining, CASE WHEN i < 5 THEN 0.0 ELSE round((3600000000 - since) / 1e6, 3) END::DOUBLE AS retry_after FROM r""",
    "w_rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, t AS since, 1 AS used, true AS allowed FROM e WHERE i = 1 UNION ALL
 SELECT e.event_id, e.user_id, e.i, CASE WHEN e.t - r.since > 86400 THEN e.t ELSE r.since END, CASE WHEN e.t - r.since > 86400 THEN 1 WHEN r.used >= 3 THEN r.used ELSE r.used + 1 END, e.t - r.since > 86400 OR r.used < 3
 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, allowed, CAST(CASE WHEN allowed THEN 3 - used ELSE 0 END AS INT) AS remaining FROM r""",
    "x_counted": ctes("versions") + " SELECT file_path, CASE WHEN entity_count = 0 AND version_number < 4 THEN 11 ELSE entity_count END AS entity_count FROM versions",
}
