"""Ranks reach hosts that are many links away."""

import pytest

from weftline.llm import urlfilter


def test_url_ranks_of_a_long_chain(spark):
    n = 58
    hosts = spark.createDataFrame([(f"h{i}", 0, 1_000_000 if i == n - 1 else 0) for i in range(n)], "host string, allowed long, blocked long")
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(n - 1)], "src string, dst string, w long")
    got = {r["host"]: r["distrust"] for r in urlfilter.ranks(hosts, edges).collect()}
    for i in range(n):
        assert got[f"h{i}"] == pytest.approx(0.15 * 1_000_000 * 0.85 ** (n - 1 - i), rel=1e-6)


def test_linked_query_is_pagerank(spark):
    """The registered query on linked hosts against a linear solver."""
    import collections

    import numpy as np

    from weftline.llm import queries

    got = queries.urlfilter_linked(spark, "/root/testdata/sf0.001").collect()
    name = lambda n: f"h{n % 60}.{'com' if n % 60 % 7 == 0 else 'net'}"
    hosts, links, seeds = [name(n) for n in range(60)], collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        k = r["page_id"]
        path = "/es/a" if k % 5 == 0 else "/fr/b" if k % 11 == 0 else "/x"
        kind = 0 if name(k).endswith(".com") else 1 if path != "/x" else 2
        seeds[name(k)][kind] += 1
        assert (r["host"], r["path"]) == (name(k), path) and (r["rule"] is None) == (kind == 2)
        for to in {name(k * 7 + 1), name(k + 1)} - {name(k)}:
            links[name(k), to] += 1
    w = np.array([[links[a, b] for b in hosts] for a in hosts], float)
    down, up = w / np.maximum(w.sum(1, keepdims=True), 1), w / np.maximum(w.sum(0, keepdims=True), 1)
    d, s = urlfilter.DAMPING, np.array([seeds[h] for h in hosts], float)
    trust = np.linalg.solve(np.eye(60) - d * down.T, (1 - d) * s[:, 0])
    distrust = np.linalg.solve(np.eye(60) - d * up, (1 - d) * s[:, 1])
    share = distrust / (distrust + trust + (1 - d) * s[:, 2] + 1e-12)
    bad = {h for h, x in zip(hosts, share, strict=True) if x > urlfilter.THRESHOLD}
    free = [r for r in got if r["rule"] is None]
    assert all((r["verdict"] == "block") == (r["host"] in bad) for r in free)
    assert {r["verdict"] for r in free} == {"allow", "block"}
