"""The pipeline's near duplicates against brute force over five-word shingles."""

import numpy as np

import pytest
from pyspark.sql import functions as F

from weftline.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_kept(rows, similar=0.8):
    """The ids that are the least of their group, by all pairs."""
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        first.setdefault(frozenset(shingles(text)), i)
    nodes = [(i, s) for s, i in first.items()]
    root = {i: i for i, _ in nodes}

    def top(i):
        return i if root[i] == i else top(root[i])

    for x, (i, s) in enumerate(nodes):
        for j, z in nodes[:x]:
            if similarity(s, z) >= similar:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted(i for i in root if top(i) == i)


def test_near_dedup_of_real_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert 2 in got and 56 not in got  # of similarity 0.967, their fingerprints five bits apart


@pytest.mark.parametrize("part", [2048, 8])
def test_near_dedup_of_chains_hubs_and_common_passages(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(10**6)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(12):  # chains: each step replaces words, so the ends are far apart
        text = [word() for _ in range(120)]
        for _ in range(10):
            rows.append((len(rows), " ".join(text)))
            text = text.copy()
            for at in rng.integers(0, 120, rng.integers(1, 5)):
                text[at] = word()
    hub = [word() for _ in range(150)]
    for _ in range(80):  # a large group around one text, and texts that share a passage only
        rows.append((len(rows), " ".join([*hub, *(word() for _ in range(rng.integers(0, 40)))])))
        rows.append((len(rows), " ".join([*passage, *(word() for _ in range(rng.integers(3, 60)))])))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "a b c d e f"), (5006, "a b c d e g")]
    got = simhash.kept(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(rows)
    groups = dict(map(tuple, simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert sorted(k for k, c in groups.items() if k == c) == brute_kept(rows) and len(groups) == len(rows)


def test_near_dedup_of_repeated_ids(spark):
    """No text is lost to another of its id; rows without an id stay; other columns are whatever they are."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, b), (1, a), (2, a.upper() + "  "), (3, b + " tail"), (4, "other words"), (None, a), (None, a), (5, None), (5, ""), (5, "ü\u00a0x"), (6, "Ü\u00a0x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `a.b`", "2 AS node", "3 AS digest", "4 AS k")
    got = simhash.kept(docs)
    assert got.columns == docs.columns
    left = [(r["doc_id"], (r["text"] or "").lower().strip()) for r in got.collect()]
    assert sorted(left, key=str) == sorted([(1, a), (1, b), (4, "other words"), (None, a), (None, a), (5, ""), (5, "ü\u00a0x"), (6, "ü\u00a0x")], key=str)
    digests = docs.where("doc_id is not null").select("doc_id", simhash.digest(F.col("text")).alias("d")).distinct().collect()
    assert sorted(map(str, digests)) == sorted({str(r) for r in simhash._signatures(docs).selectExpr("doc_id", "digest AS d").collect()})


@pytest.mark.parametrize("homes", [False, True])
def test_alike_is_all_pairs(homes):
    rng = np.random.default_rng(6)
    for n in (1, 2, 40):
        base = [rng.integers(0, 10**6, 30) for _ in range(4)]
        sets = [np.unique(np.where(rng.random(30) < 0.08, rng.integers(0, 10**6, 30), base[k % 4])).astype(np.uint64) for k in range(n)]
        asked = rng.random(n) < 0.5 if homes else np.ones(n, bool)
        root = list(range(n))
        for i in range(n):
            for j in range(n):
                if (asked[i] or asked[j]) and similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8:
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
        assert simhash.alike(sets, 0.8, asked if homes else None).tolist() == root


def test_apart_keeps_all_rows(spark, monkeypatch):
    from weftline.llm import common

    docs = spark.range(2000).selectExpr("if(id % 97 = 0, null, id) AS doc_id", "id AS `a.b`", "1 AS _bits", "2 AS _page")
    keys = common.stage_table(docs.where("doc_id % 10 = 3").select("doc_id"))
    for slots in (common.SLOTS, common._PAGE):
        monkeypatch.setattr(common, "SLOTS", slots)
        some, rest = common.apart(docs, keys, "doc_id")
        assert some.columns == docs.columns and some.count() + rest.count() == 2000
        assert some.count() < 400 and rest.where("doc_id % 10 = 3").count() == 0
        assert common.without(docs, keys, "doc_id").where("doc_id is null").count() == 21
        assert common.without(docs, keys, "doc_id").count() == 2000 - keys.count()
    none = common.stage_table(keys.limit(0))
    assert common.without(docs, none, "doc_id").count() == 2000 and common.without(docs.limit(0), keys, "doc_id").count() == 0
