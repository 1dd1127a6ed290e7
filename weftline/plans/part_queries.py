"""Registered queries of operators whose inputs the tables lack: pages, documents and files are put together from rows of part."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import jsonops
from weftline.functions import pages as P
from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.operators import catalog, change, clusters
from weftline.operators.query import QuerySpec, compile_json, compile_typed
from weftline.operators.versions import file_stats
from weftline.plans.tables import d, nested_orders, sql, t
from weftline.sources import codecs, readers, scratch
from weftline.sources.publish import Published
from weftline.streaming import state as S


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("string"))


def _by(*cases) -> Column:
    """One of cases by the key."""
    out = F.when(F.lit(False), F.lit(""))
    for i, c in enumerate(cases):
        out = out.when(F.col("p_partkey") % len(cases) == i, c)
    return out


def _sql_by(*cases: str) -> str:
    return f"CASE p_partkey % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p[1:]) if p.startswith("=") else F.col(p) for p in parts))


def _sql_cat(*parts: str) -> str:
    return "concat(" + ", ".join("'" + p[1:].replace("'", "''") + "'" if p.startswith("=") else "p_partkey" if p == "k" else p for p in parts) + ")"


def _py(f, kind: str = "string"):
    """A Python function of one text as a column expression, a batch at a time."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


def _out(make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _part(spark, sf_dir).select("p_partkey", make().alias("out"))

    return query


def _sql_out(expr: str) -> str:
    return f"SELECT p_partkey, {expr} AS out FROM part"


# --- texts -----------------------------------------------------------------------------------------------------

#: A tilde stands for a backslash.
_ESCAPED = lambda: X.decode_escapes(_cat("p_name", "= caf~u00e9 ~u0041~u4e2d ~u0007end ~ud83d.".replace("~", chr(92)), "k"))
_JSON_PAGE = lambda: F.to_json(F.struct(F.col("p_brand").alias("b"), F.struct(F.concat(F.col("p_name"), F.lit(" in a long name")).alias("n"), F.lit("http://long.example.com/x").alias("u")).alias("a"), F.array(F.lit("NewsArticle"), F.lit("SiteNavigationElement"), F.lit("some more words here")).alias("z")))
_TITLED = lambda: _by(_cat('={"@graph":[{"x":1},{"name":"', "p_name", '="}],"headline":"h"}'), _cat('={"headline":"', "p_brand", '=","name":"n"}'), _cat('={"name":"', "k", '="}'), F.lit("[1]"), F.lit("none"))
_REPLY = lambda: _by(_cat('=```json\n[{"a":', "k", "=}]\n```"), _cat('=[{"a":', "k", '=},{"b":2},{"c"'), _cat('=[{"a":', "k", "=}"), F.lit("sorry"))


def t_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("og:description"), _by(F.col("p_name"), F.lit("")), F.lit("description"), F.col("p_brand"))
    return _part(spark, sf_dir).select("p_partkey", X.description(F.when(F.col("p_partkey") % 7 > 0, meta).otherwise(F.create_map(F.lit("x"), F.lit("y")))).alias("out"))


def t_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", X.format_payload(_by(F.lit(""), F.col("p_brand")), _by(F.lit("  "), F.col("p_name"), F.col("p_type")), 2).alias("p")).select("p_partkey", "p.*")


# --- pages -----------------------------------------------------------------------------------------------------

_HEAD = ('=<html><head><title> Part ', "k", '= </title><meta name="description" content="', "p_brand", '="><meta property="og:type" content="x"><link rel="canonical" href="http://c.com/', "k", '="></head><body>')
_BODY = (
    "=<nav><p>this is navigation that nobody needs to read</p></nav><div role=\"banner\"><p>and this is a banner of the same kind</p></div><h1>", "p_name", "= is the first of all lines</h1><p>short</p>",
    '=<p>Now see <a href="/docs/', "k", '=.pdf">the document</a> &amp; <a href="page.html#x">the page</a> as well.<script>no()</script></p><P>now see the document &amp; the page as well.</p>',
    '=<ul><li>An item that is never closed, of ', "p_brand", '=<li>Another one that is not closed either</ul><a href="mailto:', "k", '=@a.com ">m</a><a href="tel:+1 23">t</a></body></html>',
)


def _pages(spark: SparkSession, sf_dir: str, html: Column) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", F.concat(F.lit("http://a.com/x/"), "k").alias("url"), html.alias("html"))


def _content(links: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = P.extracted(_pages(spark, sf_dir, _cat(*_HEAD, *_BODY)), links=links)
        return out.select("p_partkey", "title", "content", "alternate", F.element_at("metadata", "description").alias("description"), F.size("metadata").cast("bigint").alias("n_meta"))

    return query


def _content_sql(links: bool) -> str:
    more = "chr(10), 'http://a.com/x/page.html#x', " if links else ""
    return (
        "SELECT p_partkey, concat('Part ', p_partkey) AS title, concat(p_name, ' is the first of all lines', chr(10), 'Now see the document & the page as well.', chr(10), 'http://a.com/docs/', p_partkey, '.pdf', " + more
        + "chr(10), 'An item that is never closed, of ', p_brand, chr(10), 'Another one that is not closed either', chr(10), 'Email: ', p_partkey, '@a.com', chr(10), 'Phone: +1 23') AS content, "
        "concat('http://c.com/', p_partkey) AS alternate, p_brand AS description, 2 AS n_meta FROM part"
    )


def h_plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML, JSON and text pages as lines."""
    xml = _cat('=<?xml version="1.0"?><a:r xmlns:a="u"><a:name> ', "p_name", "= </a:name><empty/><secret>XXXXXXXX</secret><n>", "k", "=</n></a:r>")
    js = _cat('={"b":{"n":', "k", '=,"z":null},"a":["', "p_brand", '=",{"c":true}]}')
    rows = _pages(spark, sf_dir, _by(xml, js, _cat("=  ", "p_name", "= and text ")))
    return P.extracted(rows).select("p_partkey", "title", "content")


_LONG = "=" + "words of a body that is long enough " * 8


def _data(kind: str, body: tuple) -> tuple:
    return {
        "state": ("=<html><body><script>window.__INITIAL_STATE__ = ", *body, "=;</script></body></html>"),
        "chunks": ("=<html><body><script>self.__next_f.push([1,", *body, "=])</script></body></html>"),
        "linked": ('=<html><body><script type="application/ld+json"> ', *body, "= </script></body></html>"),
    }[kind]


_ITEM = ('={"headline":"', "p_name", '=","text":"', _LONG, '="}')
_SMALL = ('={"headline":"', "p_name", '="}')


def h_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _by(*(_cat(*_data(kind, body)) for kind in ("state", "chunks", "linked") for body in (_ITEM, _SMALL)))
    return P.extracted(_pages(spark, sf_dir, html)).select("p_partkey", "embedded")


def h_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _cat("=<script>fetch('/data/", "k", "=?a=1');axios.get(\"http://b.com/api/x\");let p='/api/v9/", "k", "=', q=\"/v1/list\", r='feed.json';</script>")
    return P.extracted(_pages(spark, sf_dir, html)).select("p_partkey", F.array_join("endpoints", "|").alias("out"))


def h_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that surely or probably need a browser: a mount point alone, a framework's script, and prose."""
    prose = "=<html><body><h1>Title</h1><p>" + "the cat and the dog are all that you can get for one day out but not her " * 6 + "</p></body></html>"
    mount = '=<html><body><div id="root"></div><noscript>You need to enable JavaScript to run this.</noscript><script src="/static/js/bundle.12ab.js"></script></body></html>'
    shell = '=<html><body><div id="x">a</div><script src="/_next/x.js"></script><script src="/lib/svelte.js"></script></body></html>'
    out = P.extracted(_pages(spark, sf_dir, _by(_cat(prose), _cat(mount), _cat(shell))))
    return out.select("p_partkey", "confirmed_app", "app_score", "app_anchor")


def h_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = _by(_cat("=../y/", "k"), _cat("=//B.com/", "k"), _cat("=?q=", "k"), F.lit("javascript:x()"), F.lit("#"), _cat("=https://c.org/", "k"))
    return _part(spark, sf_dir).select("p_partkey", U.resolve(F.concat(F.lit("http://a.com/x/z/"), "k"), href).alias("out"))


# --- posts and comments ----------------------------------------------------------------------------------------


def h_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.to_json(F.struct(F.col("p_name").alias("title"), _by(F.lit("[deleted]"), _cat("=see https://x.org/", "k", "=.png and https://y.org/", "k"), F.lit("plain")).alias("selftext"), F.col("p_brand").alias("subreddit"), F.col("p_size").alias("score")))
    listing = F.concat(F.lit('{"data":{"children":[{"kind":"t1","data":{"title":"no"}},{"kind":"t3","data":'), data, F.lit('},{"kind":"t3","data":{"title":"second"}}]}}'))
    page = F.concat(F.lit("["), listing, F.lit(',{"data":{"children":[{"kind":"t3","data":{"title":"never"}}]}}]'))
    found = readers.projected_posts(readers.posts(_part(spark, sf_dir).select(_by(listing, page).alias("value"))), {"title", "body", "subreddit", "score", "images", "links"})
    return found.select("title", "body", "subreddit", "score", F.array_join("images", "|").alias("images"), F.array_join("links", "|").alias("links"))


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select(
        F.col("p_partkey").alias("comment_id"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey") - F.col("p_partkey") % 4).alias("parent_id"),
        F.when(F.col("p_partkey") % 20 == 8, "AutoModerator").when(F.col("p_partkey") % 9 == 1, "Talbot").otherwise(F.col("p_brand")).alias("author"), F.when(F.col("p_partkey") % 20 == 12, "[removed]").otherwise(F.col("p_name")).alias("body"),
    )


def h_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.visible_comments(_comments(spark, sf_dir)).select("comment_id", "parent_id", "author")


# --- change and clusters ---------------------------------------------------------------------------------------


def d_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(1), F.col("p_size") * 3), lambda i: F.concat(F.lit("line "), i.cast("string")))
    return _part(spark, sf_dir).select("p_partkey", F.array_join(change.sampled(rows), ",").alias("sampled"), F.array_join(change.clipped(F.transform(rows, lambda x: F.concat(x, F.repeat(F.lit("x"), F.col("p_size") * 5)))), ",").alias("clipped"))


def d_entity_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _cat('={"a":', "k", '=,"b":"x","_source":"s","gone":1}')
    new = _by(_cat('={"a":', "k", '=.0,"b":"x","_source":"t"}'), _cat('={"a":1,"b":"y","new":2}'), F.lit("{}"))

    @F.pandas_udf("boolean")
    def differs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([change.entity_changed(x, y) for x, y in zip(a, b, strict=True)])

    return _part(spark, sf_dir).select("p_partkey", differs(old, new).alias("out"))


def c_diff_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d(spark, sf_dir, "crawl").withColumn("status", F.when(F.col("queue_id") % 3 > 0, "pending-diff").otherwise("done")).unionByName(d(spark, sf_dir, "recrawl").withColumn("status", F.lit("pending-diff")))
    return clusters.diff_clusters(rows).select("queue_id", "role", F.col("primary").alias("primary_id"))


def r_next_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.next_datasets(d(spark, sf_dir, "queue"), "failed")


# --- entities --------------------------------------------------------------------------------------------------


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("n"), F.col("p_name").alias("t")).alias("in"), F.col("p_partkey").alias("k"), F.lit("s").alias("_source")))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("_ord"), doc.alias("doc"))


def q_flatten_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened before the filter, which then goes by the flat name."""
    spec = QuerySpec(flatten_first=True, filters=(("in_n", "7"),), keep=("k", "in_n", "in_t"))
    return compile_json(spec, _entities(spark, sf_dir)).select(F.col("_ord").alias("p_partkey"), "doc")


def q_flatten_first_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_typed(QuerySpec(flatten_first=True, keep=("o_orderkey", "buyer_state"), filters=(("buyer_state", "f"),)), nested_orders(spark, sf_dir)).drop("_ord")


def q_flatten_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.table(_entities(spark, sf_dir))


def q_strip_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_json(QuerySpec(include_source=False), _entities(spark, sf_dir)).select(F.col("_ord").alias("p_partkey"), "doc")


def q_keywords_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec(keep=("n_nationkey", "n_name"), keywords=("nation", "1"), keywords_mode="and")
    return compile_typed(spec, t(spark, sf_dir, "nation").withColumn("_ord", F.col("n_nationkey"))).drop("_ord")


# --- sinks and sources -----------------------------------------------------------------------------------------


def s_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh(spark, "jsonl")
    codecs.write_jsonl(_entities(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("doc"))


def _delimited(sep: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch.fresh(spark, "cells")
        codecs.write_csv(_entities(spark, sf_dir), path, sep)
        return spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)

    return query


def s_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh(spark, "cells")
    codecs.write_parquet(_entities(spark, sf_dir), path)
    return spark.read.parquet(path)


def s_xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh(spark, "xml")
    codecs.write_xml_rows(_entities(spark, sf_dir), path)
    return spark.read.format("xml").option("rowTag", "entity").schema("brand string, in_n string, in_t string, k string").load(path)


def _document(make):
    """One document of each brand's entities, by a function of (name, entities) -> pieces; entities of one brand are few."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _entities(spark, sf_dir).join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ord"), "p_size"), "_ord").where("_ord % 40 = 0")

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            rows = frame.sort_values("_ord")
            return pd.DataFrame({"p_size": [int(rows["p_size"].iloc[0])], "document": [make([jsonops.decode(x) for x in rows["doc"]])]})

        return docs.groupBy("p_size").applyInPandas(run, "p_size int, document string")

    return query


def _lines(kind: str):
    """All entities of `part` as one document, written in parallel: its lines with their counts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch.fresh(spark, kind)
        codecs.write_document(_entities(spark, sf_dir), path, kind, "a & b", ["brand", "k", "none"])
        return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))

    return query


def s_version_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version file with all entities of `part`, as a document written in parallel, read back by splits."""
    path = scratch.fresh(spark, "version")
    rows = _entities(spark, sf_dir)
    first = rows.agg(F.min("_ord")).scalar()
    line = F.when(F.col("_ord") == first, F.col("doc")).otherwise(F.concat(F.lit(","), "doc"))
    frame = spark.createDataFrame([(-1, '{"total":1,"posts":[],"entities":['), (1 << 62, "]}")], "_ord long, value string")
    # One file is one writer's; it writes the sorted lines as they come.
    rows.select("_ord", line.alias("value")).unionByName(frame).orderBy("_ord").select("value").coalesce(1).write.text(path)
    got = readers.entities(spark, path, whole=0)
    return got.select(F.col("_ord").alias("place"), F.get_json_object("doc", "$.k").cast("bigint").alias("k"), F.get_json_object("doc", "$.in.t").alias("t"))


def s_version_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version files of JSON, one for each size: written, and read back as entities."""
    folder = scratch.fresh(spark, "versions")
    rows = _entities(spark, sf_dir).join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ord"), "p_size"), "_ord")
    whole = rows.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("_ord", "doc"))).alias("e"))
    kind = F.when(F.col("p_size") % 2 == 0, '{"entities":[').otherwise('{"entities":[],"posts":[')
    whole.select(F.col("p_size").alias("size"), F.concat(kind, F.array_join("e.doc", ","), F.lit("]}")).alias("value")).write.partitionBy("size").text(folder)
    got = readers.entities(spark, f"{folder}/*/*.txt")
    return got.select(F.regexp_extract("path", r"size=(\d+)", 1).cast("int").alias("size"), F.col("_ord").alias("place"), F.get_json_object("doc", "$.k").cast("bigint").alias("k"), F.get_json_object("doc", "$.in.t").alias("t"))


def s_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.fresh(spark, "versions")
    rows = t(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.array_join(F.collect_list(F.lit("{}")), ",").alias("e"))
    kind = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"total":'), (F.col("n") + 1).cast("string"), F.lit(',"entities":['))).when(F.col("p_size") % 3 == 1, '{"posts":[').otherwise('{"total":0,"entities":[')
    rows.select(F.col("p_size").alias("size"), F.concat(kind, "e", F.lit("]}")).alias("value")).write.partitionBy("size").option("lineSep", "\n").text(folder)
    got = file_stats(spark, f"{folder}/*/*.txt")
    return got.select(F.regexp_extract("path", r"size=(\d+)", 1).cast("int").alias("size"), "count", F.col("size").alias("bytes"))


def s_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _by(F.col("p_name"), F.lit("  "), _cat("= Été No. ", "k"))
    return _part(spark, sf_dir).select("p_partkey", codecs.file_name(name, F.col("p_partkey"), F.col("p_size"), "csv").alias("main"), codecs.file_name(name, F.col("p_partkey"), F.col("p_size"), "zip", alt=True).alias("alt"))


def s_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("price now"), F.array(F.col("p_brand"), F.col("p_type")).alias("list")))
    return _part(spark, sf_dir).select("p_partkey", readers.product_fields(raw, ["title", "price now", "list", "asin"]).alias("f")).select("p_partkey", "f.title", F.col("f.`price now`").alias("price"), "f.list", "f.asin")


def s_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved search results by the search source; one file for each region."""
    folder = scratch.fresh(spark, "saved").removeprefix("file:")
    names = [r["r_name"] for r in t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    os.makedirs(folder)
    for i, name in enumerate(names):
        with open(f"{folder}/{'-'.join(name.lower().replace('_', ' ').split())}.json", "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"url": f"http://{i}.com/{k}", "title": name, "snippet": f"s{k}"}) + "\n" for k in range(i + 1))
    spark.dataSource.register(readers.SearchSource)
    return spark.read.format("weft_search").option("path", folder).option("queries", "| ".join([*names, "no such"])).load()


def s_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks in an archive, read back as cells; one for each size."""
    docs = _entities(spark, sf_dir).join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ord"), "p_size"), "_ord").where("_ord % 40 = 0")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import io
        import re
        import zipfile

        rows = frame.sort_values("_ord")
        data = codecs.archive({"b.xlsx": codecs.workbook([jsonops.decode(x) for x in rows["doc"]], ["brand", "k"]), "a.txt": b"x"})
        with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(io.BytesIO(z.read("b.xlsx"))) as book:
            sheet = book.read("xl/worksheets/sheet1.xml").decode()
            names = "|".join(z.namelist())
        cells = re.findall(r'<c r="([A-Z]+)(\d+)"[^>]*>(?:<is><t[^>]*>([^<]*)</t></is>|<v>([^<]*)</v>)</c>', sheet)
        return pd.DataFrame([(int(rows["p_size"].iloc[0]), names, int(n), c, a or b) for c, n, a, b in cells], columns=["p_size", "files", "line", "letter", "cell"])

    return docs.groupBy("p_size").applyInPandas(run, "p_size int, files string, line int, letter string, cell string")


def s_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written, written again, read, measured and deleted; one for each region."""
    store, out = readers.Objects(spark, scratch.fresh(spark, "objects")), []
    for r in t(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        key = f"regions/{r['r_regionkey']}.txt"
        store.write(key, b"old")
        store.write(key, r["r_name"].encode())
        out.append((r["r_regionkey"], store.read(key).decode(), store.size(key), store.delete(key), store.delete(key)))
    return spark.createDataFrame(out, "r_regionkey int, content string, bytes bigint, deleted boolean, again boolean")


def s_versions_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saving twice what is equal and once what is not: versions 1 and 2, the second active; then a push, that a frozen dataset refuses."""
    folder = scratch.fresh(spark, "store")
    rows = _entities(spark, sf_dir)
    table = spark.createDataFrame([], "dataset_id bigint, version_number int, file_path string, entity_count bigint, created_at timestamp, is_active boolean")
    at = F.lit("2024-01-01").cast("timestamp")
    for df in (rows, rows.withColumn("doc", F.regexp_replace("doc", ":", ": ")), rows.where("_ord % 2 = 0")):
        table = readers.save_version(df, table, folder, 5, at)
    queue = spark.createDataFrame([(5, "done"), (5, "failed"), (6, "pending")], "dataset_id bigint, status string")
    one = lambda frozen: spark.createDataFrame([(5, frozen)], "dataset_id bigint, is_frozen boolean")
    refused = readers.push(rows, queue, one(True), folder, 5, 2)
    pushed = readers.push(rows.where("_ord % 5 = 0"), queue, one(False), folder, 5, 2)
    alt = readers.read_version(spark, folder, 5, 2, alt=True).count()
    return table.select("version_number", "entity_count", "is_active", F.lit(refused).alias("refused"), F.lit(pushed).alias("pushed"), F.lit(alt).cast("bigint").alias("alt_count"))


def s_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by what is made from itself."""
    table = Published(spark, scratch.fresh(spark, "swapped"))
    table.replace(lambda _: t(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return table.replace(lambda last: last.where("n_nationkey % 2 = 0"))


# --- work ------------------------------------------------------------------------------------------------------


def w_cooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = t(spark, sf_dir, "events").select(F.concat(F.lit("e"), (F.col("user_id") % 50).cast("string")).alias("engine"), "ts", F.expr("CASE event_id % 7 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Blocked by owner' ELSE 'ok' END").alias("message"))
    return S.cooling(calls, calls.agg(F.max("ts")).scalar(), 86400)


def w_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _part(spark, sf_dir).select(F.col("p_partkey").alias("queue_id"), _by(F.lit("web"), F.lit("amazon"), F.lit("reddit"), F.lit(None).cast("string")).alias("kind"), F.expr("CASE p_size % 5 WHEN 0 THEN 'crawling' WHEN 1 THEN 'proceed-format' WHEN 2 THEN 'proceed-version' WHEN 3 THEN 'pending' ELSE 'done' END").alias("status"))
    finished = _part(spark, sf_dir).where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("queue_id"), (F.col("p_partkey") % 3 == 1).alias("ok"))
    return S.advanced(queue, finished)


def w_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all kinds, run from their first stage to the end by ticks over a stream of results; a row fails in one of eleven ticks."""
    at = scratch.fresh(spark, "ticks")
    kind = _by(F.lit("web"), F.lit("amazon"), F.lit("reddit"), F.lit(None).cast("string"))
    queue = _part(spark, sf_dir).select(F.col("p_partkey").alias("queue_id"), kind.alias("kind")).withColumn("status", F.when(F.col("kind") == "reddit", "pending").otherwise("crawling"))
    Published(spark, f"{at}/queue").replace(lambda _: queue)
    results = queue.select("queue_id")
    for k in range(max(map(len, S.NEXT.values()))):
        results.withColumn("ok", F.col("queue_id") % 11 != k).write.mode("append").parquet(f"{at}/results")
        stream = spark.readStream.schema("queue_id bigint, ok boolean").parquet(f"{at}/results")
        S.run_ticks(stream, S.ticked(f"{at}/queue", S.stepped), f"{at}/checkpoint").awaitTermination()
    return Published(spark, f"{at}/queue").read()


def w_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetching by a function that stands for the network: a failure is an empty result."""

    def fetch(url: str) -> str:
        if url.endswith("7"):
            raise OSError("no such page")
        return f"got {url}"

    urls = _part(spark, sf_dir).select(F.concat(F.lit("http://"), F.lower("p_brand"), F.lit(".com/"), "k").alias("url"))
    return S.per_domain(urls, U.domain(F.col("url")), fetch, 4)


def w_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries to a receiver that takes all, none, or nothing it can answer."""

    def send(url: str, body: str) -> int:
        if url.endswith("3"):
            raise OSError("refused")
        return 500 if url.endswith("5") else 204

    return S.deliver(_part(spark, sf_dir).select(F.concat(F.lit("http://h.com/"), "k").alias("url"), F.col("p_name").alias("body")), send, pause=lambda _: None)


def w_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket of five tokens asked every three seconds by a clock of its own."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        clock = [0.0]
        bucket = S.TokenBucket(5, 60.0, now=lambda: clock[0])
        waits = []
        for i in range(len(frame)):
            clock[0] = 3.0 * i
            waits.append(bucket.wait())
        return frame.sort_values("n_nationkey")[["n_regionkey", "n_nationkey"]].assign(wait=waits)

    return t(spark, sf_dir, "nation").withColumn("n_regionkey", F.lit(0)).groupBy("n_regionkey").applyInPandas(run, "n_regionkey int, n_nationkey int, wait double").drop("n_regionkey")


QUERIES = {
    "t_escapes": _out(_ESCAPED), "t_entities": _out(lambda: X.unescape_html(_by(_cat("p_name", "= &amp; &lt;b&gt; &eacute;&#39;&#x41; &nope"), F.col("p_name")))), "t_code_mark": _out(lambda: X.clean(_cat("p_name", "= a ```x\ny``` b <pre>z</pre> c"), code="mark")),
    "t_json_strings": _out(lambda: _py(X.json_strings)(_JSON_PAGE())), "t_json_title": _out(lambda: _py(X.json_title)(_TITLED())), "t_fix_unicode": _out(lambda: _py(X.fix_unicode)(_by(_cat("p_name", "= ~u00e9~u4e2d".replace("~", chr(92))), _cat("p_name", "= ~u00zz".replace("~", chr(92))), F.col("p_name")))),
    "t_description": t_description, "t_payload": t_payload, "t_salvage": _out(lambda: _py(X.salvage_json_array)(_REPLY())),
    "h_content": _content(False), "h_content_links": _content(True), "h_plain_pages": h_plain_pages, "h_embedded": h_embedded, "h_endpoints": h_endpoints, "h_app": h_app, "h_resolve": h_resolve,
    "h_content_types": _out(lambda: P.content_type(_by(F.lit(" <?xml version='1.0'?><a/>"), F.lit("\n[1]"), F.lit('{"a":1}'), F.lit("no tags"), F.lit("<p>x"), F.lit("<SEC-DOCUMENT>x")))), "h_bots": _out(lambda: U.is_bot(_by(F.lit("AutoModerator"), F.lit("TalBOT"), F.lit("alice")))),
    "h_useful_state": _out(lambda: P.useful_state(_by(_cat(*_ITEM), _cat(*_SMALL), _cat('=["/_next/static/chunks/', *_ITEM)))), "h_posts": h_posts, "h_comments": h_comments,
    "d_sampled": d_sampled, "d_entity_changed": d_entity_changed, "c_diff_cluster": c_diff_cluster, "r_next_datasets": r_next_datasets,
    "q_flatten_first": q_flatten_first, "q_flatten_first_typed": q_flatten_first_typed, "q_flatten_export": q_flatten_export, "q_strip_source": q_strip_source, "q_keywords_both": q_keywords_both,
    "s_jsonl": s_jsonl, "s_csv": _delimited(","), "s_tsv": _delimited("\t"), "s_parquet": s_parquet, "s_xml_rows": s_xml_rows, "s_json_document": _document(lambda rows: "".join(codecs.json_document(rows))), "s_xml_document": _document(lambda rows: "".join(codecs.xml_document(rows, "a & b"))),
    "s_xml_flat": _document(lambda rows: "".join(codecs.flat_xml_document(rows, ["brand", "k", "none"], "a & b"))), "s_version_file": s_version_file, "s_version_scan": s_version_scan, "s_json_lines": _lines("json"), "s_xml_lines": _lines("xml"), "s_flat_lines": _lines("flat"), "s_file_stats": s_file_stats, "s_file_name": s_file_name, "s_product": s_product, "s_search": s_search, "s_versions_saved": s_versions_saved, "s_swap": s_swap, "s_workbook": s_workbook, "s_objects": s_objects,
    "w_cooling": w_cooling, "w_advanced": w_advanced, "w_ticks": w_ticks, "w_per_domain": w_per_domain, "w_deliver": w_deliver, "w_tokens": w_tokens,
}


# --- SQL -------------------------------------------------------------------------------------------------------

_ITEM_SQL, _SMALL_SQL = _sql_cat(*_ITEM), _sql_cat(*_SMALL)
_DOC = "concat('{\"_source\":\"s\",\"brand\":\"', p_brand, '\",\"in\":{\"n\":', p_size, ',\"t\":\"', p_name, '\"},\"k\":', p_partkey, '}')"
_RAW = "concat('{\"brand\":\"', p_brand, '\",\"in\":{\"n\":', p_size, ',\"t\":\"', p_name, '\"},\"k\":', p_partkey, ',\"_source\":\"s\"}')"
_CELLS = "SELECT p_brand AS brand, CAST(p_size AS VARCHAR) AS in_n, p_name AS in_t, CAST(p_partkey AS VARCHAR) AS k FROM part"
_NL = "chr(10)"
_PRETTY = f"concat('  {{', {_NL}, '    \"_source\": \"s\",', {_NL}, '    \"brand\": \"', p_brand, '\",', {_NL}, '    \"in\": {{', {_NL}, '      \"n\": ', p_size, ',', {_NL}, '      \"t\": \"', p_name, '\"', {_NL}, '    }},', {_NL}, '    \"k\": ', p_partkey, {_NL}, '  }}')"
_XML = f"concat('  <entity>', {_NL}, '    <_source>s</_source>', {_NL}, '    <brand>', p_brand, '</brand>', {_NL}, '    <in>', {_NL}, '      <n>', p_size, '</n>', {_NL}, '      <t>', p_name, '</t>', {_NL}, '    </in>', {_NL}, '    <k>', p_partkey, '</k>', {_NL}, '  </entity>', {_NL})"
_FLAT = f"concat('    <entity>', {_NL}, '      <brand>', p_brand, '</brand>', {_NL}, '      <k>', p_partkey, '</k>', {_NL}, '      <none></none>', {_NL}, '    </entity>', {_NL})"


def _documents(head: str, row: str, sep: str, tail: str) -> str:
    return f"SELECT p_size, concat({head}, string_agg({row}, {sep} ORDER BY p_partkey), {tail}) AS document FROM part WHERE p_partkey % 40 = 0 GROUP BY p_size"


_XML_HEAD = f"'<?xml version=\"1.0\" encoding=\"UTF-8\"?>', {_NL}, '<dataset name=\"a &amp; b\">', {_NL}"


def _line_counts(head: str, row: str, sep: str, tail: str) -> str:
    return f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split(rtrim(concat({head}, string_agg({row}, {sep} ORDER BY p_partkey), {tail}), {_NL}), {_NL})) AS line FROM part) GROUP BY line"


ORACLE_SQL = {
    "t_escapes": _sql_out("concat(p_name, ' cafe A中 end �.', p_partkey)"), "t_entities": _sql_out(_sql_by("concat(p_name, ' & <b> é''A &nope')", "p_name")), "t_code_mark": _sql_out("concat(p_name, ' a BLOCK b BLOCK c')"),
    "t_json_strings": _sql_out("concat(p_name, ' in a long name', CASE WHEN strlen(p_brand) > 10 THEN concat(' ', p_brand) ELSE '' END, ' some more words here')"), "t_json_title": _sql_out(_sql_by("p_name", "p_brand", "CAST(p_partkey AS VARCHAR)", "''", "''")),
    "t_fix_unicode": _sql_out(_sql_by("concat(p_name, ' é中')", "concat(p_name, ' ~u00zz')".replace("~", chr(92)), "p_name")), "t_description": _sql_out("CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END"),
    "t_payload": f"SELECT p_partkey, {_sql_by('NULL', 'p_brand')} AS source_url, {_sql_by('NULL', 'p_name', 'p_type')} AS content FROM part",
    "t_salvage": _sql_out(_sql_by("concat('[{\"a\":', p_partkey, '}]')", "concat('[{\"a\":', p_partkey, '},{\"b\":2}]')", "concat('[{\"a\":', p_partkey, '}]')", "NULL")),
    "h_content": _content_sql(False), "h_content_links": _content_sql(True),
    "h_plain_pages": f"SELECT p_partkey, '' AS title, {_sql_by('concat(' + repr('name: ') + ', p_name, chr(10), ' + repr('n: ') + ', p_partkey)', 'concat(' + repr('a_1: ') + ', p_brand, chr(10), ' + repr('a_2_c: true') + ', chr(10), ' + repr('b_n: ') + ', CASE WHEN p_partkey >= 1000000 THEN NULL ELSE p_partkey END)', 'concat(p_name, ' + repr(' and text') + ')')} AS content FROM part",
    "h_embedded": f"SELECT p_partkey, {_sql_by(*[_ITEM_SQL, chr(39) * 2] * 3)} AS embedded FROM part",
    "h_endpoints": _sql_out("concat('http://a.com/data/', p_partkey, '?a=1|http://a.com/api/v9/', p_partkey, '|http://a.com/v1/list|http://a.com/x/feed.json')"),
    "h_app": f"SELECT p_partkey, {_sql_by('false', 'false', 'true')} AS confirmed_app, CAST({_sql_by('0', '7', '4')} AS INT) AS app_score, {_sql_by('false', 'true', 'false')} AS app_anchor FROM part",
    "h_resolve": _sql_out(_sql_by("concat('http://a.com/x/y/', p_partkey)", "concat('http://B.com/', p_partkey)", "concat('http://a.com/x/z/', p_partkey, '?q=', p_partkey)", "''", "''", "concat('https://c.org/', p_partkey)")),
    "h_content_types": _sql_out(_sql_by("'xml'", "'json'", "'json'", "'text'", "'html'", "'xml'")), "h_bots": _sql_out(_sql_by("true", "true", "false")), "h_useful_state": _sql_out(_sql_by("true", "false", "false")),
    "h_posts": "SELECT p_name AS title, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('see https://x.org/', p_partkey, '.png and https://y.org/', p_partkey) ELSE 'plain' END AS body, p_brand AS subreddit, p_size AS score, CASE p_partkey % 3 WHEN 1 THEN concat('https://x.org/', p_partkey, '.png') ELSE '' END AS images, CASE p_partkey % 3 WHEN 1 THEN concat('https://y.org/', p_partkey) ELSE '' END AS links FROM part UNION ALL SELECT 'second', NULL, NULL, NULL, '', '' FROM part WHERE p_partkey % 2 = 0",
    "h_comments": "WITH c AS (SELECT p_partkey AS comment_id, CASE WHEN p_partkey % 4 > 0 THEN p_partkey - p_partkey % 4 END AS parent_id, CASE WHEN p_partkey % 20 = 8 THEN 'AutoModerator' WHEN p_partkey % 9 = 1 THEN 'Talbot' ELSE p_brand END AS author, CASE WHEN p_partkey % 20 = 12 THEN '[removed]' ELSE p_name END AS body FROM part), v AS (SELECT * FROM c WHERE body <> '[removed]' AND author NOT IN ('AutoModerator', 'Talbot')) SELECT comment_id, parent_id, author FROM v WHERE parent_id IS NULL OR parent_id IN (SELECT comment_id FROM v WHERE parent_id IS NULL)",
    "d_sampled": "SELECT p_partkey, array_to_string(list_transform(list_filter(range(n), lambda i: i % greatest(n // 37, 1) = 0)[:CASE WHEN n <= 37 THEN 1000 ELSE 37 END], lambda i: concat('line ', i + 1)), ',') AS sampled, (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT i, x, sum(strlen(x)) OVER (ORDER BY i) AS upto FROM (SELECT i, CASE WHEN strlen(y) > 200 THEN concat(y[:200], '…') ELSE y END AS x FROM (SELECT unnest(range(1, least(n, 75) + 1)) AS i, concat('line ', unnest(range(1, least(n, 75) + 1)), repeat('x', p_size * 5)) AS y))) WHERE upto <= 8000) AS clipped FROM (SELECT p_partkey, p_size, CAST(p_size * 3 AS BIGINT) AS n FROM part)",
    "d_entity_changed": _sql_out(_sql_by("false", "true", "false")),
    "c_diff_cluster": f"WITH q AS (SELECT queue_id, dataset_url_id, regexp_replace(trim(lower(url)), '/+$', '') AS n FROM (SELECT * FROM {sql('crawl')} WHERE queue_id % 3 > 0 UNION ALL SELECT * FROM {sql('recrawl')})) SELECT queue_id, CASE WHEN count(*) OVER w = 1 THEN 'solo' WHEN row_number() OVER (PARTITION BY n ORDER BY queue_id) = 1 THEN 'primary' ELSE 'waiting' END AS role, CASE WHEN row_number() OVER (PARTITION BY n ORDER BY queue_id) > 1 THEN first_value(dataset_url_id) OVER (PARTITION BY n ORDER BY queue_id) END AS primary_id FROM q WINDOW w AS (PARTITION BY n)",
    "r_next_datasets": f"SELECT DISTINCT dataset_id FROM {sql('queue')} WHERE status = 'failed' ORDER BY dataset_id LIMIT 20",
    "q_flatten_first": "SELECT p_partkey, concat('{\"in_n\":7,\"in_t\":\"', p_name, '\",\"k\":', p_partkey, '}') AS doc FROM part WHERE p_size = 7", "q_flatten_first_typed": "SELECT o_orderkey, o_orderstatus AS buyer_state FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "q_flatten_export": _CELLS, "q_strip_source": "SELECT p_partkey, concat('{\"brand\":\"', p_brand, '\",\"in\":{\"n\":', p_size, ',\"t\":\"', p_name, '\"},\"k\":', p_partkey, '}') AS doc FROM part",
    "q_keywords_both": "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation') AND (contains(lower(n_name), '1') OR contains(CAST(n_nationkey AS VARCHAR), '1'))",
    "s_jsonl": f"SELECT {_RAW} AS doc FROM part", "s_csv": _CELLS, "s_tsv": _CELLS, "s_parquet": _CELLS, "s_xml_rows": _CELLS,
    "s_json_document": _documents(f"'[', {_NL}", _PRETTY, f"concat(',', {_NL})", f"{_NL}, ']'"), "s_xml_document": _documents(_XML_HEAD, _XML, "''", f"'</dataset>', {_NL}"), "s_xml_flat": _documents(f"{_XML_HEAD}, '  <entities>', {_NL}", _FLAT, "''", f"'  </entities>', {_NL}, '</dataset>'"),
    "s_json_lines": _line_counts(f"'[', {_NL}", _PRETTY, f"concat(',', {_NL})", f"{_NL}, ']'"), "s_xml_lines": _line_counts(_XML_HEAD, _XML, "''", f"'</dataset>', {_NL}"), "s_flat_lines": _line_counts(f"{_XML_HEAD}, '  <entities>', {_NL}", _FLAT, "''", f"'  </entities>', {_NL}, '</dataset>'"),
    "s_version_scan": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_partkey AS k, p_name AS t FROM part",
    "s_version_file": "SELECT p_size AS size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS place, p_partkey AS k, p_name AS t FROM part",
    "s_file_stats": "SELECT p_size AS size, CASE WHEN p_size % 3 = 0 THEN count(*) + 1 ELSE count(*) END AS count, count(*) * 3 - 1 + 3 + CASE p_size % 3 WHEN 0 THEN strlen(concat('{\"total\":', count(*) + 1, ',\"entities\":[')) WHEN 1 THEN 10 ELSE 23 END AS bytes FROM part GROUP BY p_size",
    "s_file_name": "SELECT p_partkey, concat(s, '-v', p_size, '.csv') AS main, concat(s, '-v', p_size, '-alt.zip') AS alt FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN regexp_replace(replace(lower(trim(p_name)), ' ', '-'), '[^a-z0-9_-]', '', 'g') WHEN 1 THEN concat('dataset-', p_partkey) ELSE concat('t-no-', p_partkey) END AS s FROM part)",
    "s_product": "SELECT p_partkey, p_name AS title, CAST(p_size AS VARCHAR) AS price, concat('[\"', p_brand, '\",\"', p_type, '\"]') AS list, CAST(NULL AS VARCHAR) AS asin FROM part",
    "s_search": "SELECT r_name AS query, CAST(i AS INT) AS position, concat('http://', n, '.com/', i) AS url, r_name AS title, concat('s', i) AS snippet FROM (SELECT r_name, n, unnest(range(n + 1)) AS i FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS n FROM region))",
    "s_versions_saved": "SELECT CAST(v AS INT) AS version_number, CASE v WHEN 1 THEN count(*) ELSE count(*) FILTER (p_partkey % 2 = 0) END AS entity_count, v = 2 AS is_active, false AS refused, true AS pushed, count(*) FILTER (p_partkey % 5 = 0) AS alt_count FROM part, (VALUES (1), (2)) x(v) GROUP BY v",
    "s_workbook": "WITH p AS (SELECT p_size, p_brand, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) + 1 AS line FROM part WHERE p_partkey % 40 = 0) SELECT p_size, 'a.txt|b.xlsx' AS files, CAST(line AS INT) AS line, letter, cell FROM (SELECT p_size, line, 'A' AS letter, p_brand AS cell FROM p UNION ALL SELECT p_size, line, 'B', concat(p_partkey, '.0') FROM p UNION ALL SELECT DISTINCT p_size, 1, 'A', 'brand' FROM p UNION ALL SELECT DISTINCT p_size, 1, 'B', 'k' FROM p)",
    "s_objects": "SELECT r_regionkey, r_name AS content, strlen(r_name) AS bytes, true AS deleted, false AS again FROM region",
    "s_swap": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0",
    "w_cooling": "SELECT concat('e', user_id % 50) AS engine, coalesce(max(CASE WHEN event_id % 7 IN (0, 1) THEN ts END) > (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND, false) AS cooling FROM events GROUP BY user_id % 50",
    "w_ticks": f"SELECT queue_id, kind, CASE WHEN queue_id % 11 < CASE WHEN kind IN ('amazon', 'reddit') THEN 3 ELSE 5 END THEN 'failed' ELSE 'done' END AS status FROM (SELECT p_partkey AS queue_id, {_sql_by("'web'", "'amazon'", "'reddit'", "NULL")} AS kind FROM part)",
    "w_advanced": "SELECT queue_id, kind, CASE WHEN queue_id % 3 = 0 THEN status WHEN queue_id % 3 = 2 THEN 'failed' WHEN kind IS NULL OR kind = 'web' THEN CASE status WHEN 'crawling' THEN 'proceed-clean' WHEN 'proceed-format' THEN 'proceed-extract' WHEN 'proceed-version' THEN 'done' ELSE status END WHEN kind = 'amazon' THEN CASE status WHEN 'crawling' THEN 'proceed-format' WHEN 'proceed-format' THEN 'proceed-version' WHEN 'proceed-version' THEN 'done' ELSE status END ELSE CASE status WHEN 'pending' THEN 'proceed-combine' WHEN 'proceed-version' THEN 'done' ELSE status END END AS status FROM (SELECT p_partkey AS queue_id, CASE p_partkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'amazon' WHEN 2 THEN 'reddit' END AS kind, CASE p_size % 5 WHEN 0 THEN 'crawling' WHEN 1 THEN 'proceed-format' WHEN 2 THEN 'proceed-version' WHEN 3 THEN 'pending' ELSE 'done' END AS status FROM part)",
    "w_per_domain": "SELECT url, CASE WHEN p_partkey % 10 = 7 THEN '' ELSE concat('got ', url) END AS result FROM (SELECT p_partkey, concat('http://', lower(p_brand), '.com/', p_partkey) AS url FROM part)",
    "w_deliver": "SELECT concat('http://h.com/', p_partkey) AS url, CAST(CASE p_partkey % 10 WHEN 3 THEN 0 WHEN 5 THEN 500 ELSE 204 END AS INT) AS status, CAST(CASE WHEN p_partkey % 10 IN (3, 5) THEN 3 ELSE 1 END AS INT) AS tries FROM part",
    "w_tokens": "SELECT n_nationkey, CAST(CASE WHEN i % 20 < 5 THEN 0 ELSE 60 - 3 * (i % 20) END AS DOUBLE) AS wait FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)",
}
