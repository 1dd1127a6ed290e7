"""The ten operators and the pipeline: brute force, round trips, held-out accuracy and odd inputs."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftline.llm import bpe, common, decontam, embedding, langid, license, lm, quality, queries, simhash, urlfilter, warc

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and one-word texts, ties, repeated rows and a very long text.
ODD = [
    (1, "The cat sat on the mat. The cat sat on the mat again, and again.", "en", "a", 1),
    (1, "The cat sat on the mat. The cat sat on the mat again, and again.", "en", "a", 1),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (None, "one", "en", "a", 3),
    (4, "   \t\n ", "en", "a", 3),
    (5, "Ünï 123 \u00a0\u2028 x\x1cy 日本語 🙂", "de", "b", 3),
    (6, "word " * 30_000, "en", "a", 150_000),
    (7, "x" * 20_000, "en", "a", 20_000),
    (8, "12345 !!! ---", "en", "a", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns whose names clash with what the operators add.
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 AS score", "'x' AS fp", "2 AS ids", "0 AS id", "0 AS h", "'k' AS key", "1 AS node", "true AS train", "0 AS `a.b`")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(rows):
    return [r[1] or "" for r in rows]


def components_of(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            m = min(root[i], root[j])
            if (root[i], root[j]) != (m, m):
                root[i] = root[j] = m
                changed = True
    return root


# --- components ------------------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50, 80)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 9), (9, 3), (9, 2)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(50, 81), 50), **dict.fromkeys(range(100, 140), 100), 3: 2, 9: 2, 2: 2}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: language model -----------------------------------------------------------------------------------------


def brute_lm(rows, order, train):
    counts = [collections.Counter() for _ in range(order)]
    tokens = [(t or "").encode().lower().split() + [" "] for t in texts(rows)]
    for r, w in zip(rows, tokens, strict=True):
        if train(r):
            s = ["<s>", *w]
            for i in range(1, len(s)):
                for n in range(1, min(order, i + 1) + 1):
                    counts[n - 1][tuple(s[i - n + 1 : i + 1])] += 1
    total, kinds = sum(counts[0].values()), len(counts[0])
    contexts = [collections.Counter() for _ in range(order)]
    for n in range(1, order):
        for g, c in counts[n].items():
            contexts[n][g[:-1]] += c

    def p(h, w):
        if not h:
            return (counts[0][(w,)] + 1) / (total + kinds + 1)
        m = lm.MASS + lm.SHARE * contexts[len(h)][h]
        return (counts[len(h)][(*h, w)] + m * p(h[1:], w)) / (contexts[len(h)][h] + m)

    out = []
    for w in tokens:
        s = ["<s>", *w]
        score = sum(math.log10(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))
        out.append((len(w), sum(counts[0][(x,)] > 0 for x in w), total, round(sum(math.log10(p((), x)) for x in w), 4), round(score, 4)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_is_the_smoothed_model(spark, odd, order):
    held = lambda r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*ODD_COLUMNS).limit(60).collect()]
    for rows in (ODD, real):
        df = odd if rows is ODD else spark.createDataFrame(rows, DOCS)
        got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in lm.folds(df, order).collect())
        assert got == sorted(brute_lm(rows, order, lambda r: not held(r)))


ODD_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("packet", [1, 10**9])
def test_lm_over_many_blocks_and_buckets(spark, monkeypatch, packet):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(lm, "PACKET", packet)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = [tuple(r) for r in docs.select(*ODD_COLUMNS).collect()]
    want = brute_lm(rows, lm.ORDER, lambda r: zlib.crc32(str(r[0]).encode()) % 7 != 2)
    got = {r["doc_id"]: r for r in lm.folds(docs).collect()}
    for r, w in zip(rows, want, strict=True):
        g = got[r[0]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:3] and (g["base_score"], g["score"]) == pytest.approx(w[3:], abs=1e-3)


def test_lm_of_nothing(spark, none):
    assert lm.folds(none).count() == 0
    got = lm.scored(spark.createDataFrame(ODD[:1], DOCS), F.lit(False)).first()
    assert (got["train_tokens"], got["base_score"], got["score"]) == (0, 0.0, 0.0)


def test_lm_tokens_are_those_of_the_contract():
    import pyarrow as pa

    ids, lengths, words = lm.tokenized(pa.array(["A b\x0bc\x1cd\u00a0e É", None, " \t"]))
    assert [words[i].decode() for i in ids] == ["a", "b", "c\x1cd\u00a0e", "É", " ", " ", " "] and lengths.tolist() == [5, 1, 1]


# --- 2: WARC ---------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "y" * 700_000
    rows = [(1, "http://a/", "x" * 100), (2, "http://a/ b\r\nc", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "v", long), (None, "n", "z" * 200), (1, "http://a/", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    revisits = {2: 1, 8: 7}
    want = [(k, len((t or "").encode()), sha(t), "revisit" if k in revisits else "response", revisits.get(k)) for k, _, t in rows]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = str(tmp_path / "w")
    warc.write(warc.typed(pages), folder, segment=1000)
    records = warc.read(spark, folder)
    assert records.where("type = 'continuation'").count() >= 700
    again = warc.payloads(warc.reassembled(records)).where("record_id = '<urn:page:7>'").first()
    assert bytes(again["payload"]).decode() == long
    with pytest.raises(Exception, match="broken segments"):
        warc.reassembled(records.where("segment <> 3")).collect()


def test_warc_files_are_gzip_members(spark, tmp_path):
    import gzip

    folder = str(tmp_path / "w")
    warc.write(warc.typed(spark.createDataFrame([(1, "u", "a" * 300), (2, "u", "b")], "page_id long, url string, html string").coalesce(1)), folder)
    (file,) = (p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    data = gzip.decompress(file.read_bytes())
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")


def test_chunked_framing():
    for n in (0, 1, 99, 100, 101):
        assert warc.dechunked(warc.chunked(b"z" * n, 100)) == b"z" * n
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


# --- 3: licenses -----------------------------------------------------------------------------------------------


def test_license_spans(spark, odd, none):
    index = license.Index()
    text = "Intro.\nReleased under the MIT License.\nAll rights reserved. All Rights Reserved!\nThis work is licensed under the very GNU General Public License, version 3."
    got = index.matches(text)
    assert [(g[0], text[g[1] : g[2]]) for g in got] == [
        ("MIT", "Released under the MIT License"), ("reserved", "All rights reserved"), ("reserved", "All Rights Reserved"),
        ("GPL-3.0", "This work is licensed under the very GNU General Public License, version 3"),
    ]
    assert index.matches("The license of the public work is reserved for all.") == []
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string").withColumn("words", F.lit("clash"))
    assert license.scanned(rows).count() == 8 and license.scanned(odd).count() == 0 and license.scanned(none).count() == 0


def test_license_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(1, 4, 9), rng.integers(1, 4, 12)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(best[i, j] + (a[i] == b[j]), best[i, j + 1], best[i + 1, j])
        n, first, last, at = license.aligned(a, b, -12, 12)
        assert n == best[-1, -1] == len(at) and 0 <= first <= last < len(b)


def test_license_lines_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved."]
    want = {(r["doc_id"], x) for r in docs.collect() for x in lines if x in r["text"]}
    got = {(r["doc_id"], r["s"]) for r in license.scanned(docs).join(docs, "doc_id").selectExpr("doc_id", "substring(text, start + 1, end - start) || '.' AS s").collect()}
    assert want and got == want


# --- 4: BPE ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return bpe.Encoder(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(encoders):
    own, other = encoders
    rng = np.random.default_rng(5)
    samples = [t for t in texts(ODD)] + ["".join(map(chr, rng.integers(32, 0x2FFF, 60))) for _ in range(300)] + ["ab" * 5000, " " * 999 + "x", "<|endoftext|>", "é" * 300]
    for t in samples:
        assert own.encode(t) == other.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_bpe_memo_generations(encoders, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    own, other = bpe.Encoder(encoders[0].ranks, PATTERN), encoders[1]
    t = " ".join(f"wordling{i % 7}" for i in range(50))
    assert own.encode(t) == other.encode_ordinary(t)


def test_bpe_digests(odd, none, encoders):
    got = sorted(map(tuple, bpe.digests(odd, RANKS, PATTERN).collect()), key=str)
    ids = [(r[0], encoders[1].encode_ordinary(r[1] or ""), r[1] or "") for r in ODD]
    want = [(k, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, i, t in ids]
    assert got == sorted(want, key=str)
    assert bpe.digests(none, RANKS, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(odd.drop("ids"), RANKS, PATTERN), RANKS).select("doc_id", "decoded", "source").collect()
    assert {(r[0], bytes(r[1]).decode()) for r in back} == {(r[0], r[1] or "") for r in ODD}


# --- 5: URL filter ---------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.COM/en/a?b#c", "http://a.example.com/en/x", "http://a.example.com/de", "http://b.net/es/", "http://b.net", "http://b.org?x=/en/", None, "no-scheme.com/en/", "http://é.Net/fr/ñ", "x://y://z/w", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.verdicts(pages).collect()}
    assert got == {
        0: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("a.example.com", "/de", "com/", "allow"),
        3: ("b.net", "/es/", "net/es/", "block"), 4: ("b.net", "", None, "allow"), 5: ("b.org", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("é.net", "/fr/ñ", "net/fr/", "block"), 9: ("y:", "//z/w", None, "allow"), 10: ("notexample.com", "/en/", "com/", "allow"),
    }
    assert urlfilter.verdicts(pages.limit(0)).count() == 0


def test_url_ranks_are_pagerank(spark):
    rng = np.random.default_rng(2)
    n = 12
    w = np.triu(rng.integers(0, 3, (n, n)), 1) + np.tril(rng.integers(0, 2, (n, n)), -1)
    allowed, blocked = rng.integers(0, 3, n), rng.integers(0, 3, n)
    hosts = spark.createDataFrame([(f"h{i}", int(allowed[i]), int(blocked[i])) for i in range(n)], "host string, allowed long, blocked long")
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, w long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urlfilter.ranks(hosts, edges).collect()}
    down = w / np.maximum(w.sum(1, keepdims=True), 1)
    up = w / np.maximum(w.sum(0, keepdims=True), 1)
    d = urlfilter.DAMPING
    trust = np.linalg.solve(np.eye(n) - d * down.T, (1 - d) * allowed)
    distrust = np.linalg.solve(np.eye(n) - d * up, (1 - d) * blocked)
    for i in range(n):
        assert got[f"h{i}"] == pytest.approx((trust[i], distrust[i]), abs=1e-3)


def test_url_hosts_that_link_to_blocked_ones_are_blocked(spark):
    bad = [(i, "http://bad.net/es/x", "") for i in range(40)]
    farm = [(100 + i, "http://farm.org/p", '<a HREF="http://Bad.net/y">') for i in range(3)]
    good = [(200, "http://good.org/", "<a href='//fine.com/'>"), (201, "http://bad.net/de", None)]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.verdicts(spark.createDataFrame(bad + farm + good, "page_id long, url string, html string")).collect()}
    assert (got[100], got[201], got[200]) == ("block", "block", "allow")


# --- 6: embeddings ---------------------------------------------------------------------------------------------


def brute_vectors(rows, c):
    """Links are of rows; in components the rows of an id are one."""
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        return v / np.sqrt((v * v).sum())

    units = [unit(r[1]) for r in rows]
    linked = [
        (i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] is not None and rows[i][2] == rows[j][2]
        and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= c
    ]
    n = collections.Counter(x for pair in linked for x in pair)
    root = components_of(len(rows), linked + [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0]])
    comp = [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]
    return sorted((rows[i][0], n[i], comp[i], rows[i][0] == comp[i]) for i in range(len(rows)))


@pytest.mark.parametrize("part", [4096, 7])
def test_embedding_links(spark, monkeypatch, part):
    monkeypatch.setattr(embedding, "PART_ROWS", part)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((5, 8))
    rows = [(k, (base[k % 5] + rng.standard_normal(8) * (0.05 if k % 3 else 0.4)).tolist(), k % 2) for k in range(90)]
    rows += [(k + 100, rows[k][1], 0) for k in range(0, 20, 2)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [nan] * 8, 0), (203, [inf, *[1.0] * 7], 0), (204, [None, *[1.0] * 7], 0), (205, rows[0][1], None), (206, rows[0][1], None), (207, rows[0][1][:7], 0), (208, [], 0)]
    # Ids that stand twice, with equal and with other vectors, of their own label and of another.
    rows += [rows[5], rows[5], (7, rows[3][1], 1), (8, rows[6][1], 0), (300, rows[1][1], 1), (300, rows[2][1], 0), (301, rows[2][1], 0), (302, None, 0), (302, rows[4][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("n", F.lit(1))
    rows = [tuple(r)[:3] for r in table.collect()]
    assert sorted(map(tuple, embedding.groups(table).collect())) == brute_vectors(rows, 0.93)
    assert embedding.groups(table.limit(0)).count() == 0


# --- 7: quality ------------------------------------------------------------------------------------------------


def test_quality_is_learned(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in got]
    assert len(right) > 80 and sum(right) / len(right) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 0, 0), (5, 1, None), (6, 0, 0), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.scored(none, labels).count() == 0
    assert {r["score"] for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.kept(odd, labels, 0.0).columns == odd.columns and quality.kept(odd, labels, 0.0).count() == len(ODD)


def test_quality_pools_whole_documents():
    net = quality.Net()
    t = bytes(range(256)) * 9
    whole = net.pooled([t, b"", b"abc"])[0]
    for i, x in enumerate([t, b"", b"abc"]):
        assert np.allclose(net.pooled([x])[0][0], whole[i], atol=1e-5)
    assert net.windows([b"x" * 1000])[0].shape[0] * quality.STRIDE >= 1000


# --- 8: SimHash ------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, odd, none):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*ODD_COLUMNS).collect()]
    rows = [r for r in ODD if r[0] is not None] + [(r[0] + 1000, *r[1:]) for r in real] + [(r[0] + 2000, (r[1] or "") + " tail", *r[2:]) for r in real]
    fps = [brute_fingerprint(t) for t in texts(rows)]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = components_of(len(rows), linked)
    comp = [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]
    got = sorted(map(tuple, simhash.groups(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == sorted((r[0], f"{fp:016x}", c) for r, fp, c in zip(rows, fps, comp, strict=True))
    assert len(linked) > 50
    assert simhash.groups(none).count() == 0 and simhash.groups(odd).count() == len(ODD)
    kept = simhash.kept(odd)
    assert kept.columns == odd.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "2", "5", "6", "7", "8", "None"]
    assert simhash.kept(none).count() == 0 and simhash.similar_groups(none).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_simhash_bit_slices(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "PART_ROWS", 16)
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 2**63, 6)
    fp = np.unique([int(centre[k % 6]) ^ sum(1 << int(b) for b in rng.integers(0, 63, 3)) for k in range(300)])
    linked = [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius]
    want = components_of(len(fp), linked)
    edges = simhash.links(spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp)], "node long, fp long"), radius)
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(fp))] == want


# --- 9: language -----------------------------------------------------------------------------------------------


def test_langid_gradients():
    net = langid.Net(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(60, 120, (5, langid.SEGMENT + 2 * langid.CONTEXT)).astype(np.uint8), np.array([0, 1, 2, 0, 1])

    def loss():
        m = langid.LETTER[x.T[langid.CORE]]
        return -(np.log(net.position_probs(net.states(x))[:, np.arange(5), y]) * m).sum() / m.sum()

    for k, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        a, e = net.params()[k], 1e-2
        was = a[at]
        a[at] = was + e
        up = loss()
        a[at] = was - e
        down = loss()
        a[at] = was
        assert (up - down) / (2 * e) == pytest.approx(g[at], rel=0.05)


def test_langid_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.labelled(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95


def test_langid_of_odd_texts(odd, none):
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.labelled(odd).collect()}
    und = {k for k, p in got if p == "und"}
    assert und == {2, 3, 4, 8} and all(0 <= s <= 1 for s in got.values())
    assert langid.labelled(none).count() == 0
    kept = langid.kept(odd, 0.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, 6, 7, None}


# --- 10: decontamination ---------------------------------------------------------------------------------------


def test_decontamination_is_exact(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(40))
    part = " ".join(f"w{i}" for i in range(34))  # 30 of 36 shingles
    less = " ".join(f"w{i}" for i in range(32))  # 28 of 36
    rows = [(1, f"Before. {item.upper()}! after"), (2, part), (3, less), (4, None), (5, ""), (6, "a b c"), (7, "z " * 50_000 + item), (7, "z"), (None, item), (8, item), (8, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS item_id", "1 AS item", "2 AS n", "3 AS w")
    items = spark.createDataFrame([(1, item), (2, "a b c"), (3, None), (4, "no such words are here at all"), (1, item), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_found"]) for r in decontam.contained(docs, items).collect()}
    assert got == {(1, 1, 36), (2, 1, 30), (7, 1, 36), (8, 1, 36)}
    kept = decontam.kept(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "6", "None"]
    assert decontam.contained(none, items).count() == 0 and decontam.contained(docs, items.limit(0)).count() == 0
    assert decontam.contained(odd, items).count() == 0


def test_decontamination_has_no_python(spark):
    plan = queries.op10_decontam(spark, SF)._jdf.queryExecution().toString() + queries.op5_urlfilter(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- queries and pipeline --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    key = sorted(got.columns)
    assert sorted(want.columns) == key
    order = [want.columns.index(k) for k in key]
    assert sorted(str(tuple(r[k] for k in key)) for r in got.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    want = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, want, SF)
        assert after.columns == docs.columns, name
        want = spark.createDataFrame(after.collect(), docs.schema)
    with open(RANKS, "rb") as f:
        other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    rows = want.collect()
    assert {r["doc_id"] for r in rows} == set(got) and 100 < len(got) < docs.count()
    assert all(got[r["doc_id"]]["n_tokens"] == len(other.encode_ordinary(r["text"])) for r in rows)
    hit = {r["doc_id"] for r in queries.op10_decontam(spark, SF).select("doc_id").collect()}
    assert not hit & set(got)


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() <= len(ODD)
