"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Nulls count as the empty text and encode to no ids; empty texts likewise. Rows are independent,
so repeats, ties and extra columns need no care; very long texts are handled whole, a long pre-token
costs a near-linear number of queue steps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import by_bytes, mapped, named, small_batches

#: Pre-tokens in each of a worker's two generations of memo, and the longest of them in
#: characters. The older goes when the younger is full; both only trade time for memory.
MEMO_ENTRIES, MEMO_CHARS = 450_000, 32
BATCH_BYTES = 2 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank from the lines of a rank file."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class RankQueue:
    """Positions by rank, and three levels of 64-bit words that say which ranks hold positions.

    buckets: rank -> the position, or a heap of several. Bit r of low (64 to a word) is set while rank r holds
    any, bit w of mid while word w of low is not zero, bit m of the top word while word m of mid is not.
    All is zero again once a queue is drained, so one serves every pre-token. Encoder.merge() works on
    the fields itself, as a call for each step would double its time.
    """

    __slots__ = ("low", "mid", "buckets")

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.buckets: dict[int, int | list[int]] = {}


class Encoder:
    """Encodes and decodes texts by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=0)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pair = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.bytes_of = {r: t for t, r in ranks.items()}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: repeatedly the leftmost pair of least rank is merged."""
        ranks, low, mid, buckets, longest = self.ranks, self.queue.low, self.queue.mid, self.queue.buckets, self.longest
        get = ranks.get
        if (whole := get(piece)) is not None:
            return (whole,)
        n, top, pair = len(piece), 0, self.pair
        # end[i]: where the part that begins at i ends; before[i]: the part before it;
        # at[i]: the rank under which the pair that begins at i is queued now, -1 if under none.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = [pair[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        at.append(-1)
        fresh = enumerate(at)
        while True:
            for i, r in fresh:
                if r < 0:
                    continue
                if r in buckets:
                    held = buckets[r]
                    if held.__class__ is int:
                        buckets[r] = [held, i] if held < i else [i, held]
                    else:
                        heappush(held, i)
                    continue
                buckets[r] = i
                w = r >> 6
                if x := low[w]:
                    low[w] = x | 1 << (r & 63)
                else:
                    low[w] = 1 << (r & 63)
                    m = w >> 6
                    mid[m] |= 1 << (w & 63)
                    top |= 1 << m
            if not top:
                break
            # Find first set, a level at a time.
            m = (top & -top).bit_length() - 1
            x = mid[m]
            w = (m << 6) + (x & -x).bit_length() - 1
            x = low[w]
            r = (w << 6) + (x & -x).bit_length() - 1
            i = buckets[r]
            if i.__class__ is int or len(i) == 1:
                del buckets[r]
                low[w] = x = x & (x - 1)
                if not x:
                    mid[m] = x = mid[m] & (mid[m] - 1)
                    if not x:
                        top &= top - 1
            if i.__class__ is not int:
                i = heappop(i)
            if at[i] != r:
                fresh = ()
                continue  # stale: the part was merged away or pairs with another now
            j = end[i]
            end[i] = k = end[j]
            at[j] = at[i] = -1
            if k < n:
                before[k] = i
                e = end[k]
                q = get(piece[i:e], -1) if e - i <= longest else -1
                at[i] = q
            else:
                q = -1
            h = before[i]
            if h >= 0:
                o = get(piece[h:k], -1) if k - h <= longest else -1
                if at[h] != o:
                    at[h] = o
                    fresh = ((h, o), (i, q))
                    continue
            fresh = ((i, q),)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _miss(self, token: str) -> tuple[int, ...]:
        ids = self.older.get(token) or self.merge(token.encode())
        if len(token) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.older, self.memo = self.memo, {}
            self.memo[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get, miss = self.memo.get, self._miss
        return list(chain.from_iterable([get(t) or miss(t) for t in self.find(text)]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_held: dict[str, Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder a worker process and rank file."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(read_ranks(data), pattern)
    return _held[key]


def _shipped(df: DataFrame, rank_file: str):
    """The rank file, read by the driver: a vocabulary has a fixed size, here under 1 MB."""
    with open(rank_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with ids array<int> in place of text (null and empty texts: no ids). A column named like an output is replaced by it.

    decoded: the name of one more column, the bytes that the ids decode to, made in the same pass by the same worker; to
    decode() the rows afterwards would take a second worker a task.
    """
    data = _shipped(df, rank_file)
    keep = [c for c in df.columns if c not in (text, ids, decoded)]
    fields = [*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    schema = T.StructType([*fields, T.StructField(decoded, T.BinaryType(), False)] if decoded else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value, pattern)
        for batch in batches:
            for part in by_bytes(batch, len(keep), BATCH_BYTES):
                rows = [enc.encode(x) for x in part.column(len(keep)).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1])))
                made = [pa.ListArray.from_arrays(pa.array(ends), flat)]
                if decoded:
                    made.append(pa.array([enc.decode(x) for x in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[f.name for f in schema.fields])

    return mapped(small_batches(df).select(*named(df, (text, ids, decoded)), F.col(text).cast("string").alias("\x00text")), run, schema)


def decode(df: DataFrame, rank_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with one more column, the bytes that the ids stand for (null ids: no bytes)."""
    data = _shipped(df, rank_file)
    keep = [c for c in df.columns if c != decoded]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {r: t for t, r in read_ranks(data.value).items()}.__getitem__
        for batch in batches:
            at = keep.index(ids)
            for i in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(i, 256)
                rows = part.column(at)
                ends, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
                out = [b"".join(map(tokens, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*keep, decoded])

    return mapped(small_batches(df).select(*named(df, (decoded,))), run, schema)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = encode(docs.select("doc_id", "text"), rank_file, pattern, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
