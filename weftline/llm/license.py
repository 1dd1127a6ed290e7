"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

A text's words are its runs of letters and digits, in lower case. Of a template's GRAM-word sequences the winnowed ones
(the least hash in every window of WINDOW; of templates of up to SHORT sequences all) stand in an inverted index of (template, place). Places of a document where an indexed
sequence stands are gathered by template and diagonal; each gathering is one candidate stretch, which is aligned with
the template within a band of at most BAND words around its diagonals. The alignment's matched words give the coverage, their first
and last the span, in characters of the text. A match holds each word of the template that tells licenses apart (versions, "later", "NC"), and
between its first and last word none that the template lacks. A match inside one of as many words or more is left out, if that is
of the same license or covers its template at least as well. A stretch of a longer template that shares no WINDOW + GRAM - 1 words in a row
with it may be missed.

Null and empty texts hold no match. Repeated rows are scanned each; a document with several matches has a row for
each, in place. Texts are read whole. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftline.llm.common import by_bytes, small_batches
from weftline.llm.license_texts import DECISIVE, TEMPLATES

GRAM, WINDOW, SHORT, BAND, COVERED = 3, 4, 16, 8, 0.8
BATCH_BYTES, MEMO = 4 << 20, 50_000
WORD = re.compile(r"[^\W_]+")


class Index:
    """Words, templates and the inverted index of their winnowed sequences. Its size is that of the templates."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        texts = [[w.lower() for w in WORD.findall(t)] for _, t in templates]
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.ids = [np.array([self.words[w] for w in t], np.int64) for t in texts]
        self.base = len(self.words) + 1
        self.telling = np.array([False, *(w in DECISIVE or any(c.isdigit() for c in w) for w in sorted(self.words))])
        self.named = np.array([False, *(w in DECISIVE for w in sorted(self.words))])
        self.wanted = [frozenset(ids[self.telling[ids]].tolist()) for ids in self.ids]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.ids):
            grams = self.grams(ids).tolist()
            hashes = [xxh64_intdigest(b"%d" % g) for g in grams]
            window = WINDOW if len(grams) > SHORT else 1
            for i in range(max(1, len(grams) - window + 1)):
                part = range(i, min(i + window, len(grams)))
                if part:
                    k = min(part, key=lambda j: (hashes[j], -j))
                    if (t, k) not in self.places[grams[k]]:
                        self.places[grams[k]].append((t, k))
        self.keys = np.array(sorted(self.places), np.int64)
        self.memo: dict = {}

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """One number for each GRAM ids in a row, -1 where a word is of no template."""
        if len(ids) < GRAM:
            return np.empty(0, np.int64)
        out, known = np.zeros(len(ids) - GRAM + 1, np.int64), np.ones(len(ids) - GRAM + 1, bool)
        for k in range(GRAM):
            part = ids[k : len(ids) - GRAM + 1 + k]
            out = out * self.base + part
            known &= part > 0
        return np.where(known, out, -1)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))

    def matches(self, text: str) -> list[tuple[str, int, int, int, int, float]]:
        """(license, start, end, matched, words, coverage) of text, in order of place."""
        lower = text.encode().lower().decode()  # ASCII only, as the templates' words are: lengths stay
        ids = self.numbers(WORD.findall(lower))
        grams = self.grams(ids)
        hits = np.flatnonzero(np.isin(grams, self.keys))
        if not len(hits):
            return []
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in hits.tolist():
            for t, o in self.places[int(grams[p])]:
                near[t].append((p - o, p))
        found = []
        for t, seen in near.items():
            seen.sort()
            start, band = 0, self.band(t)
            for i in range(1, len(seen) + 1):
                # A new stretch begins where the diagonal moves by more than the band.
                if i == len(seen) or seen[i][0] - seen[i - 1][0] > band:
                    found += self.stretch(t, ids, seen[start][0], seen[i - 1][0])
                    start = i
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(lower)]
        cover = lambda t, n: n / len(self.ids[t])
        found.sort(key=lambda x: (x[1], -x[2], -x[3], -cover(x[0], x[3]), x[0]))
        out, open_ = [], []
        for t, a, b, n in found:  # a match that holds another begins no later, so it comes first
            open_ = [x for x in open_ if x[0] >= a]
            if not any(b <= d and m >= n and (self.names[t] == self.names[o] or cover(o, m) >= cover(t, n)) for d, m, o in open_):
                open_.append((b, n, t))
                out.append((self.names[t], spans[a][0], spans[b][1], n, len(self.ids[t]), cover(t, n)))
        return out

    def band(self, t: int) -> int:
        """Narrower for short templates, lest two that follow each other fall into one stretch."""
        return min(BAND, max(1, len(self.ids[t]) // 4))

    def stretch(self, t: int, ids: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, matched) if enough of the template stands around these diagonals."""
        band = self.band(t)
        a, b = max(0, low - band), min(len(ids), high + len(self.ids[t]) + band)
        part = ids[a:b]
        key = (t, low - a, high - low, part.tobytes())
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[key] = self.judged(t, part, low - a - band, high - a + band)
        return [(t, a + got[1], a + got[2], got[0])] if got[0] else []

    def judged(self, t: int, part: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
        """Matched words, first and last word of part; 0 words where they are too few or not the ones that tell licenses apart."""
        ids = self.ids[t]
        if np.isin(ids, part).sum() < COVERED * len(ids):
            return 0, 0, 0
        n, first, last, at = aligned(ids, part, low, high)
        if n < COVERED * len(ids) or not self.wanted[t] <= set(part[at].tolist()):
            return 0, 0, 0
        span = part[first : last + 1]
        if self.named[np.setdiff1d(span, ids)].any():
            return 0, 0, 0
        return n, first, last


def aligned(template: np.ndarray, part: np.ndarray, low: int, high: int) -> tuple[int, int, int, list[int]]:
    """Words matched in order on the diagonals low..high of part against template, the first and last place in part, and all places.

    Row i of the table holds the best count ending at diagonal d, that is at part[i + d]; skipped words cost
    nothing, so along a row the best is a running maximum.
    """
    width = high - low + 1
    rows = np.zeros((len(template) + 1, width), np.int32)
    diagonal = np.arange(low, high + 1)
    for i, w in enumerate(template):
        at = i + diagonal
        inside = (at >= 0) & (at < len(part))
        hit = inside & (part[np.clip(at, 0, len(part) - 1)] == w)
        up = np.append(rows[i][1:], 0)  # the same place in part, one word of the template less
        rows[i + 1] = np.maximum.accumulate(np.maximum(up, rows[i] + hit))
    n = int(rows[-1].max())
    if not n:
        return 0, 0, 0, []
    # Back from the first diagonal that has it: the shortest end.
    i, d, places = len(template), int(rows[-1].argmax()), []
    while i > 0 and rows[i, d] > 0:
        at = i - 1 + low + d
        if 0 <= at < len(part) and part[at] == template[i - 1] and rows[i, d] == rows[i - 1, d] + 1:
            places.append(at)
            i -= 1
        elif d + 1 < width and rows[i - 1, d + 1] == rows[i, d]:
            i, d = i - 1, d + 1
        elif d and rows[i, d - 1] == rows[i, d]:
            d -= 1
        else:
            i -= 1
    return n, places[-1], places[0], places


SPANS = "license string, start int, end int, matched int, words int, coverage double"


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """(key, license, start, end, matched, words, coverage): a row for each match in each text."""
    names = [key, *(x.split()[0] for x in SPANS.split(", "))]
    kinds = [pa.string(), *[pa.int32()] * 4, pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for part in by_bytes(batch, 1, BATCH_BYTES):
                at, rows = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    got = index.matches(t) if t else []
                    at += [i] * len(got)
                    rows += got
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return small_batches(docs).select(key, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {SPANS}")
