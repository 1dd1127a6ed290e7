"""Each license template's own text is reported under its own name."""

import numpy as np
import pytest

from weftline.llm import license


@pytest.mark.parametrize("name, text", license.TEMPLATES)
def test_license_of_each_template(name, text):
    got = license.Index().matches(f"Before. {text} After.")
    assert {g[0] for g in got} == {name} and max(g[5] for g in got) == 1


def test_license_match_of_other_license_inside_a_partial_one_stays():
    index = license.Index((("long", "a b c d e f g h i j"), ("short", "c d e f g")))
    assert [(g[0], g[5]) for g in index.matches("a b c d e f g h x y")] == [("long", 0.8), ("short", 1.0)]
    assert [g[0] for g in index.matches("a b c d e f g h i j")] == ["long"]


def notice(name, part):
    return next(t for n, t in license.TEMPLATES if n == name and part in t)


@pytest.mark.parametrize("name, other", [("GPL-2.0-or-later", "GPL-3.0-or-later"), ("GPL-3.0-only", "AGPL-3.0-only"), ("LGPL-3.0-or-later", "GPL-3.0-or-later"), ("CC-BY-3.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-4.0")])
def test_license_versions_are_decisive(name, other):
    for n, text in license.TEMPLATES:
        if n == name:
            got = {g[0] for g in license.Index().matches(f"x {text} y")}
            assert name in got and other not in got


def test_license_parts_of_full_texts():
    index = license.Index()
    warranty = notice("MIT", "NONINFRINGEMENT")
    assert {g[0] for g in index.matches(f"Copyright. {warranty}")} == {"MIT"}
    assert {g[0] for g in index.matches(notice("GPL-2.0", "By contrast"))} == {"GPL-2.0"}
    bulleted = notice("BSD-3-Clause", "Neither").replace("Redistributions", "* Redistributions").replace("Neither", "3. Neither")
    assert {g[0] for g in index.matches(bulleted)} == {"BSD-3-Clause"}


def brute(templates, text):
    """Names whose template has a window of the text with enough words in order, the telling ones among them: all windows and no band."""
    words = license.WORD.findall(text.lower())
    out = set()
    for name, t in templates:
        t = license.WORD.findall(t.lower())
        telling = {w for w in t if any(c.isdigit() for c in w) or w in license.DECISIVE}
        for start in range(len(words)):
            part = words[start : start + len(t)]
            best = [[0] * (len(part) + 1) for _ in range(len(t) + 1)]
            for i, a in enumerate(t):
                weight = 1001 if a in telling else 1  # so that the best holds those first
                for j, b in enumerate(part):
                    best[i + 1][j + 1] = max(best[i][j] + (a == b) * weight, best[i][j + 1], best[i + 1][j])
            told, held = divmod(best[-1][-1], 1000)
            if held >= license.COVERED * len(t) and told == sum(w in telling for w in t) and not any(w in license.DECISIVE and w not in t for w in part):
                out.add(name)
                break
    return out


def test_license_query_against_brute_force(spark):
    """Notices as they are, with words replaced, and cut short, among other words."""
    rng = np.random.default_rng(4)
    templates = [(n, t) for n, t in license.TEMPLATES if 20 < len(license.WORD.findall(t)) < 45 and n.split("-")[0] in ("GPL", "LGPL", "AGPL", "ISC", "CC0", "Unlicense")]
    rows, want = [], []
    for name, t in templates:
        words = license.WORD.findall(t)
        telling = [i for i, w in enumerate(words) if any(c.isdigit() for c in w) or w.lower() in license.DECISIVE]
        plain = [i for i in range(len(words)) if i not in telling]
        for changed in (0, 1, 3, len(words) // 2):
            w = words.copy()
            for i in rng.choice(plain, changed, replace=False):
                w[i] = f"other{i}"
            rows.append(w)
        for i in telling:
            rows.append([*words[:i], "x", *words[i + 1 :]])
        rows += [words[: int(len(words) * 0.9)], words[: len(words) // 2], words[len(words) // 2 :]]
    rows = [" ".join([*(f"f{k}" for k in rng.integers(0, 99, 12)), *w, *(f"f{k}" for k in rng.integers(0, 99, 12))]) for w in rows]
    got = {i: set() for i in range(len(rows))}
    for r in license.scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), templates=templates).collect():
        got[r["doc_id"]].add(r["license"])
        assert r["coverage"] >= license.COVERED and r["matched"] <= r["words"]
    want = {i: brute(templates, t) for i, t in enumerate(rows)}
    for i in got:  # of matches inside each other the better one stays
        assert got[i] <= want[i] and bool(got[i]) == bool(want[i]), (rows[i], got[i], want[i])
    assert sum(bool(x) for x in want.values()) > 40 and sum(not x for x in want.values()) > 20
