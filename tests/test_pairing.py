"""The version diff's pairs against the sequential rule, entity by entity."""

import json
import random

import pytest

from weftline.functions import jsonops
from weftline.functions.scalars import canonical
from weftline.operators import versions


def by_force(old, new, weight):
    out = []
    sources = lambda side: {e.get("_source", "") for e in side}
    for src in sources(old) | sources(new):
        mine = [[e for e in side if e.get("_source", "") == src] for side in (old, new)]
        if not mine[0] or not mine[1]:
            out += [("subtracted", src, canonical(e), None, ()) for e in mine[0]] + [("added", src, None, canonical(e), ()) for e in mine[1]]
            continue
        hashed = [{jsonops.entity_hash(e): e for e in side} for side in mine]
        rest = [[h[k] for k in sorted(h) if k not in other] for h, other in (hashed, hashed[::-1])]
        free, pairs = set(range(len(rest[1]))), []
        for i, e in enumerate(rest[0]):
            score = {j: sum(max(weight.get(k, 0.0), 0.1) for k in sorted(e) if k != "_source" and e[k] is not None and canonical(rest[1][j].get(k)) == canonical(e[k])) for j in free}
            j = min(score, key=lambda j: (-score[j], j), default=None)
            if j is not None and score[j] >= 0.3:
                pairs.append((i, j))
                free.remove(j)
        out += [("modified", src, canonical(rest[0][i]), canonical(rest[1][j]), tuple(versions.field_changes(rest[0][i], rest[1][j]))) for i, j in pairs]
        out += [("subtracted", src, canonical(e), None, ()) for i, e in enumerate(rest[0]) if i not in dict(pairs)]
        out += [("added", src, None, canonical(rest[1][j]), ()) for j in free]
    return sorted(out, key=str)


def got(spark, old, new):
    sides = [spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(side)], "_ord long, doc string").repartition(3) for side in (old, new)]
    return sorted(((r["change"], r["source"], r["v1"], r["v2"], tuple(r["fields"])) for r in versions.diff(*sides).collect()), key=str)


def weights_of(old, new):
    larger = new if len(new) > len(old) else old
    return {k: len({canonical(e[k]) for e in larger if k in e}) / len(larger) for k in {k for e in larger for k in e if k != "_source"}}


@pytest.mark.parametrize("seed", range(4))
def test_diff_equals_the_sequential_one(spark, seed):
    # Few values, so that many are equally like, one source holds most entities, and partners are lost to smaller ones.
    r = random.Random(seed)
    value = lambda k: r.choice([None, 1, 2.5, "1", "x", [1, "é"], {"a": 1}][: 3 + seed]) if k != "id" else r.randrange(40)
    side = lambda: [{k: value(k) for k in ("id", "b", "c", "d", "e") if r.random() < 0.8} | ({"_source": r.choice(["s", "s", "s", "t", "u"])} if r.random() < 0.9 else {}) for _ in range(45)]
    old = side()
    new = side() + [{**e, r.choice("bcde"): "changed"} for e in old if r.random() < 0.5] + r.sample(old, 5)
    want = by_force(old, new, weights_of(old, new))
    assert {w[0] for w in want} == {"modified", "subtracted", "added"}
    assert got(spark, old, new) == want


def test_one_class_of_many_equally_like_entities(spark):
    # All share three light fields; the ids do not match, so every old entity is as like to every new one.
    old = [{"id": f"o{i}", "a": 1, "b": 1, "c": 1} for i in range(120)]
    new = [{"id": f"n{i}", "a": 1, "b": 1, "c": 1} for i in range(90)]
    want = by_force(old, new, weights_of(old, new))
    assert sum(w[0] == "modified" for w in want) == 90
    assert got(spark, old, new) == want


def test_no_source_is_one_group(spark):
    df = spark.createDataFrame([(0, '{"a": 1, "b": 2}')], "_ord long, doc string")
    plan = versions.diff(df, df.selectExpr("_ord", """'{"a": 1, "b": 3}' AS doc"""))._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan
