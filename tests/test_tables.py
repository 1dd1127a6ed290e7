"""Versions, clusters, catalogue, sources, sinks and stateful operators."""

import io
import json
import random
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from weftline.functions.scalars import canonical
from weftline.operators import change, clusters, versions
from weftline.sources import codecs, readers
from weftline.streaming import state


def entities(spark, rows):
    return spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(rows)], "_ord long, doc string")


# --- change ----------------------------------------------------------------------------------------------------


def test_lines(spark):
    row = spark.createDataFrame([("a b\nc d\nc d\n--", "c d\ne f\ne f\n\n ***")], "o string, n string").select(change.added(F.col("o"), F.col("n")), change.removed(F.col("o"), F.col("n")), change.lines(F.col("n"))).first()
    assert tuple(row) == (["e f", "e f"], ["a b"], ["c d", "e f", "e f"])


def test_ladder(spark):
    w = lambda n, s="w": "\n".join(f"{s}{i}" for i in range(n))
    rows = [("same", w(5), w(5)), ("bad_fetch", w(100), w(26)), ("enough", w(100), w(27)), ("too_little", w(100), w(100) + "\nx"), ("gray", w(100), w(100) + "\nx\ny"), ("enough", w(100), w(100) + "\n" + w(15, "z")), ("empty", w(3), ""), ("gray", "", w(3)), ("gray", None, w(3)), ("empty", w(3), None)]
    df = spark.createDataFrame(rows, "want string, old string, new string")
    got = change.ladder(df, decide=lambda lines: F.size(lines) > 2).collect()
    assert [(r["want"], r["level"]) for r in got if r["want"] != r["level"]] == []
    assert {r["proceed"] for r in got if r["level"] == "enough"} == {True} and [r["proceed"] for r in got if r["level"] == "gray"] == [False, True, True]
    links = spark.createDataFrame([("http://a\nx", "http://a"), ("http://a", "http://a\nhttp://b")], "old string, new string")
    assert [r["proceed"] for r in change.ladder(links, with_links=F.lit(True)).collect()] == [False, True]


def test_samples(spark):
    row = spark.range(1).select(change.sampled(F.sequence(F.lit(0), F.lit(99))), F.size(change.clipped(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda x: F.repeat(F.lit("é"), 150))))).first()
    assert row[0] == list(range(0, 74, 2)) and row[1] == 39
    assert change.entity_changed('{"a":1,"_source":"x"}', '{"a":1.0,"b":2,"_source":"y"}') is False and change.entity_changed('{"a":1}', '{"a":2}')


# --- versions --------------------------------------------------------------------------------------------------


def test_version_change(spark):
    one = lambda a, b: versions.changed(entities(spark, a), entities(spark, b)).first()[0]
    assert one([{"a": 1}], [{"a": 1.0}]) is False and one([{"a": 1}, {"a": 2}], [{"a": 2}, {"a": 1}]) and one([{"a": 1}], []) and one([{"a": None}], [{}]) and not one([], [])


def test_version_diff(spark):
    v1 = [{"_source": "s", "id": 1, "p": 10}, {"_source": "s", "id": 2, "p": 20}, {"_source": "t", "id": 9}, {"_source": "t", "id": 9}]
    v2 = [{"_source": "s", "id": 1, "p": 11}, {"_source": "s", "id": 3, "p": 30}]
    got = versions.diff(entities(spark, v1), entities(spark, v2)).collect()
    assert sorted((r["change"], r["source"], tuple(r["fields"])) for r in got) == [("added", "s", ()), ("modified", "s", ("p",)), ("subtracted", "s", ()), ("subtracted", "t", ()), ("subtracted", "t", ())]
    weight = {r["field"]: round(r["weight"], 3) for r in versions.weights(entities(spark, v1[:3])).collect()}
    assert weight == {"id": 1.0, "p": 0.667}
    assert versions.field_changes({"a": 1.0, "n": None}, {"a": 2.0, "b": 1.0}) == ["a", "b"]
    assert versions.diff(entities(spark, []), entities(spark, [])).count() == 0


def test_pairs_are_the_likest():
    old, new = [{"a": 1.0, "b": 1.0}, {"a": 1.0}], [{"a": 1.0}, {"a": 1.0, "b": 1.0, "c": None}]
    assert versions.paired(old, new, {"a": 0.5, "b": 0.5}) == [(0, 1), (1, 0)] and versions.paired([{"a": 1.0}], [{"a": 1.0}], {"a": 0.2}) == []
    for e, f in ((old[0], new[0]), (old[1], new[1])):
        assert versions.similarity(e, f, {"a": 0.5, "b": 0.5}) == pytest.approx(0.5)


@pytest.mark.parametrize("seed", range(40))
def test_pairs_equal_those_of_all_comparisons(seed):
    rng = random.Random(seed)
    side = lambda: [{k: rng.choice([None, 1.0, 2.0, "1", "x"][: 2 + seed % 4]) for k in "abcdef" if rng.random() < 0.8} | {"_source": "s"} for _ in range(rng.randrange(25))]
    old, new = side(), side()
    weight = {k: rng.choice([0.01, 0.1, 0.15, 0.2, 0.3, 0.9]) for k in "abcde"}
    free, want = set(range(len(new))), []
    for i, e in enumerate(old):
        score = {}
        for j in free:
            score[j] = 0.0
            for k, v in e.items():
                if k != "_source" and v is not None and new[j].get(k) == v:
                    score[j] += max(weight.get(k, 0.0), 0.1)
        j = min(score, key=lambda j: (-score[j], j), default=None)
        if j is not None and score[j] >= 0.3:
            want.append((i, j))
            free.remove(j)
    assert versions.paired(old, new, weight) == want


def test_combining(spark):
    queue = spark.createDataFrame([(2, 1, "proceed-version"), (1, 1, "proceed-version"), (3, 1, "failed"), (4, 2, "proceed-version"), (5, 2, "crawling")], "queue_id long, dataset_id long, status string")
    extracts = spark.createDataFrame([(1, "u1", ['{"a":1}', '{"a":2}']), (2, "u2", ['{"a":3}']), (4, "u4", ['{"a":4}'])], "queue_id long, source_url string, entities array<string>")
    got = sorted((r["_ord"], r["doc"]) for r in versions.combined(queue, extracts).collect())
    assert got == [(0, '{"_source":"u1","a":1}'), (1, '{"_source":"u1","a":2}'), (2, '{"_source":"u2","a":3}')]


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    urls = ["http://a.com", "http://a.com/", "http://b.com", "http://c.com", None]
    rows = [(i, rng.choice([1, 2, 3, None]), rng.choice(["h", "g", None]), urls[rng.randrange(5) if i % 3 else 0]) for i in range(60)]
    done = [(100 + i, rng.choice([1, 2, 2, None]), rng.choice(["h", "g", None]), rng.choice(urls)) for i in range(12)]
    kind = "queue_id long, dataset_id long, schema_hash string, url string"
    site = lambda u: u and u.rstrip("/")
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(done, kind)
    same = {q: [x for x, _, g, v in rows if (g, site(v)) == (h, site(u))] for q, _, h, u in rows}
    role = lambda q: ("solo", None) if len(same[q]) == 1 else ("primary", None) if q == min(same[q]) else ("waiting", min(same[q]))
    got = clusters.extract_clusters(a)
    assert got.columns == [*a.columns, "role", "primary"]
    assert {r["queue_id"]: (r["role"], r["primary"]) for r in got.collect()} == {q: role(q) for q in same} and got.count() == len(rows)
    want = {}
    for q, d, h, u in rows:
        offers = [x for x, e, g, v in done if None not in (d, e, h, u) and e != d and (g, site(v)) == (h, site(u))]
        if offers:
            want[q] = min(offers)
    assert want and {r["queue_id"]: r["from_queue_id"] for r in clusters.late_arrivals(a, b).collect()} == want
    written = {q: min(o) for q, d, h, u in rows if (o := [x for x, e, g, v in done if x % 2 and None not in (d, e, h, u) and e != d and (g, v) == (h, u)])}
    marked = b.withColumn("status", F.expr("if(queue_id % 2 = 1, 'done', 'pending')"))
    assert written and {r["queue_id"]: r["from_queue_id"] for r in clusters.reusable(a, marked).collect()} == written
    twice = clusters.cluster(spark.createDataFrame([(1, 7, "k"), (1, 7, "k"), (1, 8, "k"), (2, 6, "k")], "q long, t long, k string"), [F.col("k")], "q", "t")
    assert sorted((r["t"], r["role"], r["primary"]) for r in twice.collect()) == [(6, "waiting", 7), (7, "primary", None), (7, "primary", None), (8, "waiting", 7)]
    assert clusters.extract_clusters(a.limit(0)).count() == 0 and clusters.late_arrivals(a, b.limit(0)).count() == 0


def test_clusters(spark):
    rows = spark.createDataFrame([(10, 100, "http://A.com/"), (11, 101, "http://a.com"), (12, 102, "http://b.com")], "queue_id long, dataset_url_id long, url string")
    assert [(r["queue_id"], r["role"], r["primary"]) for r in clusters.crawl_clusters(rows).orderBy("queue_id").collect()] == [(10, "primary", None), (11, "waiting", 100), (12, "solo", None)]
    h = spark.sql("SELECT map('b', '2', 'a', '1') AS m, map('a', '1', 'b', '2') AS n").select(clusters.schema_hash(F.col("m")) == clusters.schema_hash(F.col("n"))).first()[0]
    assert h


# --- sources and sinks -----------------------------------------------------------------------------------------

ROWS = [{"name": "A & b", "n": 3.0, "tags": ["x", "y"], "reviews": [{"r": 1.5}, {"r": None}], "_source": "s"}, {"name": 'q"<', "ok": True, "o": {"k": 1234567.5}}]


def test_version_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "entities": [{"a": 1, "b": [1, None]}, 5, "x", {"a": None}]}))
    (tmp_path / "b.json").write_text(json.dumps({"total": 9, "entities": [], "posts": [{"t": 1}]}))
    got = sorted((r["path"][-6:], r["_ord"], r["doc"]) for r in readers.entities(spark, str(tmp_path / "*.json")).collect())
    assert got == [("a.json", 0, '{"a":1,"b":[1,null]}'), ("a.json", 1, '{"a":null}'), ("b.json", 0, '{"t":1}')]
    stats = {r["path"][-6:]: r["count"] for r in versions.file_stats(spark, str(tmp_path / "*.json")).collect()}
    assert stats == {"a.json": 4, "b.json": 9}
    readers.write_version(entities(spark, ROWS), str(tmp_path / "store"), 7, 2)
    assert readers.read_version(spark, str(tmp_path / "store"), 7, 2).count() == 2


def test_objects(spark, tmp_path):
    o = readers.Objects(spark, f"file://{tmp_path}")
    o.write("x/y", b"\x00\xffabc")
    o.write("x/y", b"new")
    assert o.read("x/y") == b"new" and o.size("x/y") == 3 and o.delete("x/y") and not o.delete("x/y")


def test_listings_and_comments(spark):
    post = {"kind": "t3", "data": {"title": "T", "selftext": "see https://a.org/y.png", "score": 3, "subreddit": "s"}}
    gone = {"kind": "t3", "data": {"title": "D", "selftext": "[removed]"}}
    texts = [json.dumps({"data": {"children": [post, {"kind": "t1", "data": {}}, gone]}}), json.dumps([{"data": {"children": [post]}}, {"data": {"children": []}}])]
    df = readers.posts(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert sorted(r["title"] for r in df.collect()) == ["D", "T", "T"]
    got = {r["title"]: (r["body"], r["images"]) for r in readers.projected_posts(df, {"title", "body", "images"}).collect()}
    assert got == {"T": ("see https://a.org/y.png", ["https://a.org/y.png"]), "D": ("", [])}
    rows = [(1, None, "ann", "hi"), (2, 1, "bob", "[deleted]"), (3, 2, "cid", "orphaned"), (4, 1, "helperbot", "x"), (5, 1, "dee", "ok"), (6, 5, "eve", "deep"), (7, None, None, "anon")]
    kept = readers.visible_comments(spark.createDataFrame(rows, "comment_id long, parent_id long, author string, body string"))
    assert sorted(r["comment_id"] for r in kept.collect()) == [1, 5, 6, 7]


def test_search_source(spark, tmp_path):
    (tmp_path / "two-words.json").write_text('{"url":"http://a","title":"A"}\n{"url":"http://b"}\n')
    spark.dataSource.register(readers.SearchSource)
    got = spark.read.format("weft_search").option("path", str(tmp_path)).option("queries", "Two words|none").load().collect()
    assert [(r["query"], r["position"], r["url"], r["title"]) for r in got] == [("Two words", 0, "http://a", "A"), ("Two words", 1, "http://b", None)]


def test_sinks(spark, tmp_path):
    df = entities(spark, ROWS)
    assert codecs.columns_of(df) == ["n", "name", "o_k", "ok", "reviews_0_r", "reviews_1_r", "tags"]
    codecs.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert [(r["n"], r["name"], r["o_k"], r["ok"], r["tags"]) for r in back] == [("3", "A & b", None, None, '["x","y"]'), (None, 'q"<', "1.2345675e+06", "true", None)]
    codecs.write_parquet(df, str(tmp_path / "p"))
    assert {t for _, t in spark.read.parquet(str(tmp_path / "p")).dtypes} == {"string"}
    with pytest.raises(ValueError):
        codecs.write_parquet(df.limit(0), str(tmp_path / "e"))
    codecs.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(canonical(json.loads(r["value"])) for r in spark.read.text(str(tmp_path / "j")).collect()) == sorted(canonical(e) for e in ROWS)
    codecs.write_xml_rows(df, str(tmp_path / "x"))
    assert spark.read.format("xml").option("rowTag", "entity").load(str(tmp_path / "x")).count() == 2


def test_documents(spark):
    df = entities(spark, ROWS)
    assert json.loads("".join(codecs.json_document(codecs.ordered(df)))) == ROWS == json.loads("".join(codecs.json_document(ROWS, pretty=False))) and "".join(codecs.json_document([])) == "[]"
    root = ElementTree.fromstring("".join(codecs.xml_document(codecs.ordered(df), 'N"&')))
    assert root.get("name") == 'N"&' and [e.tag for e in root[0]] == ["_source", "n", "name", "reviews", "tags"] and [x.tag for x in root[0][3]] == ["review", "review"] and root[1].find("o/k").text == "1.2345675e+06"
    flat = ElementTree.fromstring("".join(codecs.flat_xml_document(ROWS, codecs.columns_of(df), "N")))
    assert flat.find("entities")[0].find("tags").text == '["x","y"]' and flat.find("entities")[1].find("n").text is None
    z = zipfile.ZipFile(io.BytesIO(codecs.workbook(ROWS, codecs.columns_of(df))))
    sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    rows = sheet.find("{*}sheetData")
    assert len(rows) == 3 and rows[1][0].find("{*}v").text == "3.0" and rows[2][3].get("t") == "b" and rows[0][0].get("s") == "1"
    assert zipfile.ZipFile(io.BytesIO(codecs.archive({"a": b"1", "b": b"2"}))).namelist() == ["a", "b"]
    assert spark.range(1).select(codecs.file_name(F.lit("My D"), F.lit(3), F.lit(2), "csv", alt=True)).first()[0] == "my-d-v2-alt.csv"


# --- state -----------------------------------------------------------------------------------------------------


def test_rate_limits(spark):
    got = list(state.admit([float(i) / 10 for i in range(101)] + [61.0], 100))
    assert [g[0] for g in got].count(False) == 1 and got[100][1] == 0 and got[99][1] == 0 and got[101][:2] == (True, 99)
    rows = [(i, i % 2, i // 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, s long").select("id", "k", F.timestamp_seconds("s").alias("ts"))
    out = {r["id"]: (r["allowed"], r["remaining"]) for r in state.rate_limit(df, "k", "ts", "id", limit=30).collect()}
    for k in (0, 1):
        mine = [r for r in rows if r[1] == k]
        for r, g in zip(mine, state.admit([float(r[2]) for r in mine], 30), strict=True):
            assert out[r[0]] == g[:2]


def test_rate_limit_stream(spark, tmp_path):
    spark.createDataFrame([(1, i) for i in range(6)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = state.rate_limit_stream(spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in")), "k", "ts", limit=4)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["allowed"] for r in spark.table("limited").collect()) == [False] * 2 + [True] * 4


def test_ticks_and_stages(spark, tmp_path):
    q = spark.createDataFrame([(1, "web", "crawling"), (2, "amazon", "crawling"), (3, "reddit", "pending"), (4, "web", "proceed-version"), (5, "web", "done")], "queue_id long, kind string, status string")
    q.write.parquet(str(tmp_path / "q"))
    seen = []

    def tick(batch, _):
        done = state.advanced(batch, batch.select("queue_id", (F.col("queue_id") != 4).alias("ok")))
        seen.extend((r["queue_id"], r["status"]) for r in done.collect())

    state.run_ticks(spark.readStream.schema(q.schema).parquet(str(tmp_path / "q")), tick, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [(1, "proceed-clean"), (2, "proceed-format"), (3, "proceed-combine"), (4, "failed"), (5, "done")]


def test_buckets_delivery_and_cooling(spark):
    clock = [0.0]
    b = state.TokenBucket(2, 60.0, lambda: clock[0])
    assert [b.wait(), b.wait(), b.wait()] == [0.0, 0.0, 60.0]
    clock[0] = 60.0
    assert b.wait() == 0.0
    df = spark.createDataFrame([("ok", "b"), ("bad", "b")], "url string, body string")
    got = {r["url"]: (r["status"], r["tries"]) for r in state.deliver(df, lambda u, _: 200 if u == "ok" else 500, pause=lambda _: None).collect()}
    assert got == {"ok": (200, 1), "bad": (500, 3)}
    calls = spark.sql("SELECT 'a' AS engine, TIMESTAMP '2024-01-01 00:00:10' AS ts, 'HTTP 429' AS message UNION ALL SELECT 'b', TIMESTAMP '2024-01-01 00:00:10', 'fine'")
    assert {r["engine"]: r["cooling"] for r in state.cooling(calls, F.expr("TIMESTAMP '2024-01-01 00:00:30'")).collect()} == {"a": True, "b": False}
    fetched = state.per_domain(spark.createDataFrame([("http://a/1",), ("http://b/x",)], "url string"), F.substring("url", 8, 1), lambda u: str(1 // (len(u) - 10) if u.endswith("x") else u), 2)
    assert {r["url"]: r["result"] for r in fetched.collect()} == {"http://a/1": "http://a/1", "http://b/x": ""}
    assert len(state.signed({"a": 1}, "k")[1]) == 128


# --- whole ways ------------------------------------------------------------------------------------------------


def test_build(spark):
    from weftline.plans import build

    words = " ".join(f"sentence{i} goes on about something quite different every time. Then it{i} stops there for now." for i in range(40))
    rows = [(1, "http://a.com/1", f"<p>{words}</p>"), (2, "HTTP://a.com/1/", f"<p>{words}</p>"), (3, "http://a.com/2", "<p>too few words in here to stay</p>"), (4, None, None)]
    clean = build.cleaned(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [(r["page_id"], r["word_count"] >= 200) for r in clean.collect()] == [(1, True)]
    chunks = build.chunked(build.formatted(clean))
    got = build.extracted(chunks, lambda text: f'```json\n[{{"n": {len(text) // len(text)}}}, {{"m"').collect()
    assert [(r["page_id"], r["source_url"], r["entities"]) for r in got] == [(1, "http://a.com/1", ['{"n":1}'])]


def test_serving(spark):
    from weftline.plans.serve import answer

    df = entities(spark, [{"a": 1, "b": {"c": "x"}, "_source": "s"}, {"a": 2, "b": None}])
    text = lambda **p: "".join(answer(df, p))
    assert json.loads(text(include_source="false")) == [{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": None}]
    assert text(format="csv", sort="a:desc") == "_source,a,b,b_c\n,2,,\ns,1,,x\n" and text(format="csv", filter=["a:9"]) == ""
    assert text(format="jsonl", filter=["a:2"]) == '{"a":2,"b":null}\n' and text(count="true") == '{"count":2}' and text(pretty="false", limit="1", keep_field="a") == '[{"a":1}]'
    assert "<c>x</c>" in text(format="xml") and next(answer(df, {"format": "xlsx"}))[:2] == b"PK"


def test_tables_are_swapped(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    readers.swap_table(spark.range(3), path)
    readers.swap_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
