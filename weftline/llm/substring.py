"""Substring dedup: words covered by a window of `window` words that a document of smaller id holds, too, are removed.

Fixed-block anchors. With blocks of half a window, every window holds a whole block of any document that it is read in, wherever it starts. So
each document's non-overlapping blocks are the index, by hash the least document and block, and every rolling window of a
block's length of every document is a probe. A probe that meets a smaller document is a hit. Hits are extended: consecutive
blocks of the text that are consecutive blocks of one document are one exact repeat, and windows inside it are settled. What is left are the windows around a
repeat's ends; the documents whose blocks were hit there tell their own windows around these blocks, and the least document of
each window decides. Blocks follow one another in every case, so a copy costs some tens of rows, however long it is and however many copies there are.

Probes go to buckets of the hash space as packed sets of a block of texts, with their documents; buckets stream them past their part of the index.
Blocks have 48 bits of hash there: more hits than true ones only cost time. Windows are told apart by 96 bits of hash, of word hashes of 64 bits.

Words are maximal runs of characters other than the six ASCII blanks, unchanged. Null and empty texts hold none. Rows without an id lose nothing and
make no other row lose anything. Rows of one id are judged each; none is smaller than the other, so they don't take from each other. Very
long texts are split and hashed in runs. Columns other than the id and the text are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import apart, by_bytes, give_back, small_batches, stage_table, together
from weftline.llm.lm import mixed, packed, steps, unpacked

WINDOW = 50
#: Words of the texts that tell their probes together, and of a bucket; a packet holds some dozens of hashes at least.
TOLD_WORDS, BUCKET_WORDS, MOST_BUCKETS = 1 << 20, 1 << 21, 1 << 14
_BYTES, _RUN, _GATHERED = 2 << 20, 1 << 19, 1 << 21
_BLANK = re.compile(rb"[\t-\r ]")
_IN_WORD = np.array([not _BLANK.match(bytes([b])) for b in range(256)])
_BASE = np.uint64(0x9FB21C651E98DF25)
_SALT, _LOW = np.uint64(0xA24BAED4963EE407), np.uint64(16)
_NONE = np.empty(0, np.uint64)


def runs(text: bytes, most: int = _RUN) -> Iterator[list[bytes]]:
    """The words of a text, about `most` bytes of it at a time."""
    at = 0
    while at < len(text):
        end = at + most
        blank = _BLANK.search(text, end) if end < len(text) else None
        end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end


class Hasher:
    """Word hashes of texts: polynomials in a fixed odd base over random 64-bit values of the bytes, mixed with the word's length.

    Sums over a text's prefixes give those of all its words at once.
    """

    def __init__(self):
        self.value = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up) if len(self.up) < _RUN else n)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)], dtype=np.uint64) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))

    def _run(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._powers(len(text) + 1)
        word = np.zeros(len(text) + 2, bool)
        word[1:-1] = _IN_WORD[text]
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.value[text] * self.up[: len(text)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[start], (end - start).astype(np.uint64)), start

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of all texts, and where each text's begin (one more: where the last one's end)."""
        text = b"\n".join(texts)
        parts, starts, at = [_NONE], [np.empty(0, np.int64)], 0
        while at < len(text):
            end = at + _RUN
            blank = _BLANK.search(text, end) if end < len(text) else None
            end = blank.start() if blank else len(text)
            h, start = self._run(np.frombuffer(text, np.uint8, end - at, at))
            parts.append(h)
            starts.append(start + at)
            at = end
        begin = np.cumsum([0, *(len(x) + 1 for x in texts)])
        return np.concatenate(parts), np.searchsorted(np.concatenate(starts), begin)


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive hashes, put together from those of powers of two."""
    if len(h) < size:
        return _NONE
    out, have, power, width = None, 0, h, 1
    while True:
        if size & width:
            out = power if out is None else mixed(out[: len(h) - have - width + 1], power[have : len(h) - width + 1])
            have += width
        if have == size:
            return out
        power = mixed(power[:-width], power[width:])
        width *= 2


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each place lies in the `length` places from a start on."""
    n = len(starts)
    edge = np.zeros(n + length + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[: n + length] > 0


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def _each(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[list[dict]]:
    """Rows of about _BYTES of text together."""
    for batch in batches:
        for part in by_bytes(batch, column, _BYTES):
            yield part.to_pylist()


def _hashed(rows: list[dict], hashes: Hasher, block: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each row with its word hashes and 48 bits of its rolling windows of a block's length."""
    h, begin = hashes([r["text"] for r in rows])
    short = rolled(h, block) >> _LOW
    for row, a, e in zip(rows, begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        yield row, h[a:e], short[a : max(a, e - block + 1)]


def anchored(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(doc, words, blocks) of every text that holds a window: its count of words and the hashes of its blocks."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for rows in _each(batches):
            found = [(r["doc"], len(h), packed(short[::block].copy())) for r, h, short in _hashed(rows, hashes, block) if r["doc"] is not None and len(h) >= window]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc", "words", "blocks"])
        give_back()

    return _texts(docs, key, text).mapInArrow(run, "doc bigint, words bigint, blocks binary")


def _packets(h: np.ndarray, doc: np.ndarray, place: np.ndarray | None, shift: int, kind: int) -> pa.RecordBatch:
    """One row for each bucket of sorted hashes."""
    bucket = (h >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(h) else []
    spans = list(zip(cuts, [*cuts[1:], len(h)], strict=True)) if cuts else []
    return pa.RecordBatch.from_arrays([
        pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([kind] * len(spans), pa.int32()), pa.array([packed(steps(h[a:b])) for a, b in spans], pa.binary()),
        pa.array([packed(doc[a:b]) for a, b in spans], pa.binary()), pa.array([None if place is None else packed(place[a:b]) for a, b in spans], pa.binary()),
    ], names=["bucket", "kind", "hashes", "docs", "places"])


_PACKET = "bucket int, kind int, hashes binary, docs binary, places binary"


def _least(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each hash the least document and its first place, by hash."""
    by = np.lexsort((place, doc, h))
    h = h[by]
    by = by[np.r_[True, h[1:] != h[:-1]]] if len(h) else by
    return (h if len(by) == len(h) else h[np.r_[True, h[1:] != h[:-1]]]), doc[by], place[by]


def index(told: DataFrame, shift: int) -> DataFrame:
    """Packets of blocks: of each hash the least document, and the block's number there, in the rows that were read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, docs, places = (np.concatenate(x) for x in zip(*held, strict=True))
            return _packets(*_least(h, docs, places), shift, 0)

        for batch in batches:
            for row in batch.to_pylist():
                h = unpacked(row["blocks"], np.uint64)
                held.append((h, np.full(len(h), row["doc"]), np.arange(len(h), dtype=np.int64)))
                size += len(h)
                if size >= TOLD_WORDS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return told.select("doc", "blocks").mapInArrow(run, _PACKET)


def probes(docs: DataFrame, key: str, text: str, window: int, shift: int) -> DataFrame:
    """Packets of every rolling window of a block's length, with its document."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hasher(), [], 0

        def out() -> pa.RecordBatch:
            h, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(h)
            return _packets(h[by], docs[by], None, shift, 1)

        for rows in _each(batches):
            for row, h, short in _hashed(rows, hashes, block):
                if row["doc"] is None or len(h) < window:
                    continue
                for at in range(0, len(short), TOLD_WORDS):
                    some = short[at : at + TOLD_WORDS]
                    held.append((some, np.full(len(some), row["doc"])))
                    size += len(some)
                    if size >= TOLD_WORDS:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()
        give_back()

    return _texts(docs, key, text).mapInArrow(run, _PACKET)


def hits(packets: DataFrame) -> DataFrame:
    """(doc, h, ref, block): the probes that meet a block of a smaller document, with the least one. A bucket's index comes before its probes, which pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        none = (_NONE, np.empty(0, np.int64), np.empty(0, np.int64))
        known = none

        def merged() -> tuple:
            return _least(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else none

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    now, held, size, known = row["bucket"], [], 0, none
                h, doc = np.cumsum(unpacked(row["hashes"], np.uint64), dtype=np.uint64), unpacked(row["docs"], np.int64)
                if row["kind"] == 0:
                    held.append((h, doc, unpacked(row["places"], np.int64)))
                    size += len(h)
                    if size >= _GATHERED:
                        held = [merged()]
                        size = len(held[0][0]) // 2
                    continue
                if held:
                    known, held = merged(), []
                if not len(known[0]):
                    continue
                at = np.searchsorted(known[0], h)
                at[at == len(known[0])] = 0
                found = np.flatnonzero((known[0][at] == h) & (known[1][at] < doc))
                if len(found):
                    at = at[found]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(h[found].view(np.int64)), pa.array(known[1][at]), pa.array(known[2][at])], names=["doc", "h", "ref", "block"])
        give_back()

    dealt = packets.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(lambda b: together(run(b)), "doc bigint, h bigint, ref bigint, block bigint")


def _keys(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The 96 bits of the windows at these places."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    a, b = rolled(h, window)[at], rolled(h ^ _SALT, window)[at]
    return a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _rows(*parts: list) -> list[pa.Array]:
    """Lists of numpy arrays as Arrow columns of lists, a row for each array."""
    out = []
    for arrays in parts:
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays))))
    return out


def extended(rows: DataFrame, window: int) -> DataFrame:
    """(doc, text, settled, a, b, ends) of rows (doc, text, h, ref, block): which windows lie inside exact repeats of one smaller document, packed bits; the keys of
    the windows around hits that do not; and the blocks hit there."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for row, words, h in (x for rows in _each(batches) for x in _hashed(rows, hashes, block)):
            n = max(0, len(words) - window + 1)
            known = np.array(row["h"], np.uint64)
            by = np.argsort(known)
            known, ref, place = known[by], np.array(row["ref"], np.int64)[by], np.array(row["block"], np.int64)[by]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hit = known[at] == h
            ref, place = ref[at], place[at]
            link = np.zeros(len(h), bool)  # this block and the next one follow one another in ref, too
            link[:-block] = hit[:-block] & hit[block:] & (ref[:-block] == ref[block:]) & (place[:-block] + 1 == place[block:])
            three = np.zeros(len(h), bool)
            three[:-block] = link[:-block] & link[block:]
            settled = _covered(three, 3 * block - window + 1)[:n]
            if window == 2 * block:
                settled |= link[:n]
            # A window that starts up to block - 1 places before a hit may hold the hit's block.
            near = np.zeros(len(h), bool)
            near[: n + block - 1] = hit[: n + block - 1]
            around = _covered(near[::-1], block)[: len(h)][::-1][:n]
            left = around & ~settled
            a, b = _keys(words, np.flatnonzero(left), window)
            open_ = np.zeros(len(h), bool)
            open_[:n] = left
            ends = np.unique(h[hit & _covered(open_, block)[: len(h)]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["doc"]]), pa.array([row["text"]], pa.binary()), pa.array([packed(np.packbits(settled))], pa.binary()), *_rows([a], [b], [ends])], names=["doc", "text", "settled", "a", "b", "ends"])
        give_back()

    return rows.mapInArrow(lambda b: together(run(b)), "doc bigint, text binary, settled binary, a array<bigint>, b array<int>, ends array<bigint>")


def told_around(rows: DataFrame, window: int) -> DataFrame:
    """(a, b, doc): the windows of rows (doc, text, ends) around those of their blocks that stand in ends."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for row, words, short in (x for rows in _each(batches) for x in _hashed(rows, hashes, block)):
            n = len(words) - window + 1
            at = np.flatnonzero(np.isin(short[::block], np.array(row["ends"], np.uint64))) * block
            starts = np.unique((at[:, None] - np.arange(block)).ravel())
            a, b = _keys(words, starts[(starts >= 0) & (starts < n)], window)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), row["doc"]))], names=["a", "b", "doc"])
        give_back()

    return rows.mapInArrow(lambda b: together(run(b)), "a bigint, b int, doc bigint")


_KEPT = "doc bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string"


def _kept(doc: int | None, text: bytes, removed: np.ndarray | None) -> pa.RecordBatch:
    """One row of _KEPT; removed: which words go."""
    spans, out, n = [], [], 0
    for words in runs(text):
        if removed is not None:
            keep = ~removed[n : n + len(words)]
            out.append(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]))
        else:
            out.append(b" ".join(words))
        n += len(words)
    if removed is not None:
        edge = np.flatnonzero(np.diff(np.r_[False, removed, False].astype(np.int8)))
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kept = b" ".join(x for x in out if x).decode()
    return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([n]), pa.array([spans], kind), pa.array([kept])], names=["doc", "n_words", "spans", "kept"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, spans, kept) of every row: its count of words, the spans of words that go, as (start, end), and the others joined by spaces. key: a long."""
    told = stage_table(anchored(docs, key, text, window), "blocks")
    words = told.agg(F.sum("words")).first()[0] or 0
    buckets = 1 << min(MOST_BUCKETS.bit_length() - 1, (words // BUCKET_WORDS).bit_length())
    shift = 48 - (buckets.bit_length() - 1)
    met = stage_table(hits(index(told, shift).unionByName(probes(docs, key, text, window, shift))), "hits")
    # The answers to one text are gathered; they are no more than its words.
    by_doc = met.groupBy("doc").agg(F.collect_set(F.struct("h", "ref", "block")).alias("hits")).select("doc", "hits.h", "hits.ref", "hits.block")
    ids = stage_table(met.select("doc").distinct(), "ids")
    texts = _texts(docs, key, text)
    some, rest = apart(texts, ids, "doc")
    ours = stage_table(extended(some.join(by_doc, "doc"), window), "extended")
    ends = stage_table(ours.select("doc", F.explode("ends").alias("h")).groupBy("h").agg(F.max("doc").alias("last")), "ends")

    def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = np.unique(unpacked(row["blocks"], np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), row["doc"]))], names=["h", "doc"])

    holders = told.select("doc", "blocks").mapInArrow(lambda b: together(each_block(b)), "h bigint, doc bigint").join(ends, "h").where("doc < last").select("doc", "h")
    holders = stage_table(holders, "holders")
    theirs = apart(texts, stage_table(holders.select("doc").distinct(), "holder_ids"), "doc")[0].join(holders.groupBy("doc").agg(F.collect_set("h").alias("ends")), "doc")
    # Written, so that the join below has a shuffle of its own on this side and a window that very many ask for can be split.
    least = stage_table(told_around(theirs, window).groupBy("a", "b").agg(F.min("doc").alias("least")), "least")
    asked = ours.select("doc", F.explode(F.arrays_zip("a", "b")).alias("w")).select("doc", "w.a", "w.b")
    gone = asked.join(least, ["a", "b"]).where("least < doc").groupBy("doc").agg(F.collect_set("a").alias("gone"))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for row, words, _ in (x for rows in _each(batches) for x in _hashed(rows, hashes, window // 2)):
            n = max(0, len(words) - window + 1)
            starts = np.unpackbits(unpacked(row["settled"], np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)
            if row["gone"]:
                starts |= np.isin(rolled(words, window).view(np.int64), np.array(row["gone"], np.int64))
            removed = _covered(starts, window)[: len(words)] if starts.any() else np.zeros(len(words), bool)
            yield _kept(row["doc"], row["text"], removed)
        give_back()

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for rows in _each(batches) for r in rows):
            yield _kept(row["doc"], row["text"], None)
        give_back()

    changed = ours.select("doc", "text", "settled").join(gone, "doc", "left").mapInArrow(lambda b: together(final(b)), _KEPT)
    same = rest.unionByName(some.join(ids, "doc", "left_anti").select("doc", "text")).mapInArrow(lambda b: together(untouched(b)), _KEPT)
    return changed.unionByName(same).withColumnRenamed("doc", key)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return deduplicated(docs).select("doc_id", "n_words", size.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


DIGESTS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(k, k + 50)) AS i FROM win JOIN least USING (s) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
