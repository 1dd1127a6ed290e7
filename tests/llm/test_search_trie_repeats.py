"""Ranked search, the conversation trie and substring dedup: brute force, forced rounds and blocks, odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from weftline.llm import ranked, substring, trie

DOCS = "doc_id long, text string"


# --- substring dedup ----------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_by_force(rows, window):
    least = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k : k + window])
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def kept(df, window):
    rows = substring.deduplicated(df, window=window).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_brute_force(spark, seed):
    # Few words, so that repeats of every length, overlaps and repeats inside a document abound.
    r = random.Random(seed)
    passages = [[f"p{k}w{r.randrange(4)}" for _ in range(r.randrange(5, 40))] for k in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(1, 7)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            w += p[a : a + r.randrange(1, 40)] if r.random() < 0.7 else [r.choice("ab") for _ in range(r.randrange(1, 12))]
        rows.append((r.choice([i, i, i, 7]), r.choice([" ", "\t", "\n "]).join(w)))
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for window in (6, 11):
        assert kept(df, window) == kept_by_force(rows, window)


def test_repeats_of_many_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "TOLD_WORDS", 700)
    monkeypatch.setattr(substring, "BUCKET_WORDS", 2000)
    monkeypatch.setattr(substring, "_RUN", 300)
    r = random.Random(9)
    text = " ".join(f"w{r.randrange(9**9)}" for _ in range(230))
    near = [" ".join(w if r.random() > 0.01 else "other" for w in text.split()) for _ in range(40)]
    rows = [(100 + i, text) for i in range(40)] + [(200 + i, t) for i, t in enumerate(near)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, text), (None, None), (150, text), (5, "x y " * 60), (6, "x y " * 60), (4, "z " * 400), (7, text[: len(text) // 2])]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS doc", "2 AS h", "'x' AS kept", "3 AS hits", "0 AS `a.b`").repartition(3)
    assert kept(df, 50) == kept_by_force(rows, 50)


def test_repeats_in_nothing(spark):
    assert substring.deduplicated(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(x) for x in substring.digests(spark.createDataFrame([(1, None)], DOCS)).collect()] == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]


# --- ranked search --------------------------------------------------------------------------------------------------------


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked_by_force(docs, items, k):
    bags = [(i, terms_of(t)) for i, t in docs]
    n_all, length = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms_of(t))
    out = []
    for item, q in asked.items():
        found = []
        for i, w in bags:
            tf = Counter(w)
            m = 25 + (75 * len(w) * n_all) // length if length else 0
            s = sum(c * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, c in q.items() if tf[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["Cat", "cat,", "dog", "Ünï", "ünï", "x9", "9", "a-b", "日本", "q"]) + r.choice(["", "", "!", "\x1cz"]) for _ in range(n))
    docs = [(i, text(r.randrange(0, 30))) for i in range(300)] + [(1, "cat cat"), (1, "cat cat"), (None, "cat cat dog"), (400, None), (401, ""), (402, "?!"), (403, "cat " * 5000)]
    items = [(i, text(r.randrange(0, 9))) for i in range(25)] + [(3, "cat"), (None, "cat"), (90, None), (91, "unseen"), (92, "cat " * 300)]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS id", "2 AS score", "3 AS rank", "'t' AS term", "0 AS `a.b`").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS id", "2 AS block")
    want = ranked_by_force(docs, items, 10)
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 40)  # several blocks of documents a task
    monkeypatch.setattr(ranked, "_RUN", 700)
    for most in (1 << 18, 60):  # and several blocks of items
        assert sorted(map(tuple, ranked.search(d, i, most=most).collect()), key=str) == want


def test_ranked_nothing(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "cat")], DOCS)
    items = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert ranked.search(none, items).collect() == []
    assert ranked.search(one, items.where("false")).collect() == []
    assert ranked.search(one, items).columns == ["item_id", "rank", "doc_id", "score"]


# --- conversation trie ----------------------------------------------------------------------------------------------------


def trie_by_force(rows):
    own = defaultdict(list)
    for c, t, role, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", x or ""))
    own = {c: [q[2:] for q in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, q in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + q[h:])
    members = defaultdict(list)
    for c, q in seqs.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    out = []
    for p, cs in members.items():
        below = [x for x in members if x[: len(p)] == p]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[:-1] == x for y in members)
        ends = ",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(p))
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(x) == len(p) + 1 for x in below), sum(map(leaf, below)),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("local", [4, 1 << 14])
def test_trie_equals_brute_force(spark, local):
    r = random.Random(local)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 300, 301]:
        first = r.choice(["hello", "hello", "hi ünï"])
        turns = [("user", first), *((r.choice(["user", "assistant"]), r.choice(["", "a", "b"])) for _ in range(r.randrange(0, 6)))]
        if c % 7 == 0:
            turns = [("user", "the same"), ("assistant", "words"), ("user", "again")]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(3, None, "user", "first of all"), (3, None, None, None), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "a", "tie"), (None, 0, "user", "x"), (11, 99, "user", "long " * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS ids", "3 AS digest", "0 AS `a.b`").repartition(4)
    got = sorted((tuple(x) for x in trie.digests(df, local).collect()), key=str)
    assert got == trie_by_force(rows)


def test_trie_of_nothing_one_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.digests(spark.createDataFrame([], schema)).collect() == []
    # 101 has h = crc32 % 6 turns of a conversation that is not there.
    for c in (100, 101, 102, 103):
        rows = [(c, 0, "user", "x")]
        assert sorted((tuple(x) for x in trie.digests(spark.createDataFrame(rows, schema)).collect()), key=str) == trie_by_force(rows)


def test_ids_of_a_group_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 20)
    pairs = spark.range(500).selectExpr("CAST(IF(id < 400, 'a', 'b') AS BINARY) AS digest", "id * 3 AS conv_id").repartition(7)
    got = {bytes(r["digest"]): r["ends"] for r in trie.digests_of_ids(pairs).collect()}
    want = {b"a": range(400), b"b": range(400, 500)}
    assert got == {k: hashlib.sha256(",".join(str(3 * i) for i in v).encode()).hexdigest() for k, v in want.items()}
