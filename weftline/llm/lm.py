"""Language-model scores by a weighted backoff automaton.

Learning counts all n-grams of all training texts. With c(h) the count of a context h, h' being h without its first
word, and m(h) = MASS + SHARE c(h) the weight of what h' says, smoothing is p(w | h) = (c(hw) + m(h) p(w | h')) / (c(h) + m(h)),
and p(w) = (c(w) + 1) / (N + V + 1). So a context is a state, an n-gram that was seen an arc, and a word without an arc takes
the state's failure arc to h' at log10(m(h) / (c(h) + m(h))). A text is read once from left to right: the state is carried along, the weights of
the arcs and failure arcs taken are added up.

Texts are dealt with in blocks of about BLOCK_BYTES. A block tells its distinct n-grams, as hashes with its own
counts, to buckets of the hash space; a bucket adds up the counts of all blocks and tells each block the totals of the
n-grams it asked about (or, on very large inputs, an aggregation and a join do). With those a block builds the part of the automaton that its texts can reach. Both the n-grams that are
gathered and the buckets grow with the input, no task holds more than a block or a bucket, and nothing but N and V
goes to the driver. Hashes have 64 bits, of which longer n-grams keep 56: two n-grams that share one would share their counts, of
10^12 different ones (100 TB) about one in 10^5. Words keep all bits.

Null and empty texts are the end token alone. Repeated rows are scored each and counted each. Rows without an id are
taken for id '' when the folds are drawn. Very long texts are read in pieces that start in the state which the words before
them lead to. If nothing was learned every word has probability 1. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftline.llm.common import crc_bucket, give_back, small_batches, stage_table

ORDER, MASS, SHARE = 3, 1.0, 3.0
#: Packets of a block for a bucket hold so many n-grams at least; where they would hold fewer, n-grams go as single rows.
PACKET = 64
BLOCK_BYTES, BUCKET_TOKENS, PIECE = 6 << 20, 2_000_000, 2048
#: Hash of the place before a text's first token, and the end token: a word can't hold a space.
BEGIN, END = np.uint64(0x9D39247E33776D41), " "
#: The bits of a hash that tell longer n-grams apart.
KEPT = ~np.uint64(0xFF)


def packed(x: np.ndarray) -> bytes:
    """x's bytes by plane, compressed: the high bytes of sorted or small numbers are nearly all alike."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def steps(keys: np.ndarray) -> np.ndarray:
    """What leads from each of sorted numbers to the next: shorter than the numbers, so they pack better."""
    return np.diff(keys, prepend=np.uint64(0))


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Token numbers of all texts in a row, each text's count of tokens, and the words by number (number 0: the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)[full.to_numpy(zero_copy_only=False)]
    counts = np.bincount(owner, minlength=len(lengths))
    coded = flat.filter(full).dictionary_encode()
    words = [END.encode(), *(w.encode() for w in coded.dictionary.to_pylist())]
    ids = np.zeros(len(owner) + len(counts), np.uint32)
    ends = np.cumsum(counts + 1) - 1
    place = np.ones(len(ids), bool)
    place[ends] = False
    ids[place] = coded.indices.to_numpy().astype(np.uint32) + 1
    return ids, (counts + 1).astype(np.int32), words


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    x = (a * np.uint64(0xD6E8FEB86659FD93)) ^ (b + np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Grams:
    """The n-grams of a block. For each order: the sorted distinct hashes, and every place's n-gram's index (-1: none).

    The n-gram of a place ends there; one that would begin before the place in front of the text's first token is none.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray, order: int):
        self.starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        self.keys, self.at = [], []
        h = vocabulary[ids]
        run, valid = h, np.ones(len(ids), bool)
        for n in range(1, order + 1):
            if n > 1:
                before = np.empty_like(run)
                before[1:] = run[:-1]
                if n == 2:
                    before[self.starts] = BEGIN
                else:
                    was = np.zeros_like(valid)
                    was[1:] = valid[:-1]
                    was[self.starts] = False
                    valid = was
                run = mixed(before, h)
            keys, inverse = np.unique(run[valid] & KEPT if n > 1 else run[valid], return_inverse=True)
            at = np.full(len(ids), -1, np.int64)
            at[valid] = inverse
            self.keys.append(keys)
            self.at.append(at)


def blocks(docs: DataFrame, key: str, text: str, train) -> DataFrame:
    """The texts as rows of about BLOCK_BYTES: (block, keys, train, lengths, ids, vocabulary)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"block bigint, keys array<{kind}>, train binary, lengths binary, ids binary, vocabulary binary, tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(rows).combine_chunks()
            ids, lengths, words = tokenized(table.column(2).chunk(0))
            # Fits in 64 bits: fewer than 2^32 blocks in a partition. A retried task's numbers are its own again.
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            hashes = np.array([xxh64_intdigest(w) for w in words], np.uint64)
            keys = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(0).chunk(0))
            train = table.column(1).to_numpy().astype(np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), keys, *(pa.array([packed(x)]) for x in (train, lengths, ids, hashes)), pa.array([len(ids)])],
                names=["block", "keys", "train", "lengths", "ids", "vocabulary", "tokens"],
            )

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > BLOCK_BYTES:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield block(held)
                    held, size, start = [], 0, i
                size += n
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield block(held)
        give_back()

    return small_batches(docs).select(F.col(key).alias("key"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _block(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Grams]:
    train, lengths, ids, vocabulary = (unpacked(row[c], k) for c, k in (("train", np.uint8), ("lengths", np.int32), ("ids", np.uint32), ("vocabulary", np.uint64)))
    return train.astype(bool), lengths, ids, vocabulary, Grams(ids, lengths, vocabulary, order)


def totals(parts: DataFrame, order: int, buckets: int) -> DataFrame:
    """(block, n, bucket, totals, plain, types, tokens): for each block the counts in all training texts of its n-grams.

    types and tokens stand in one row of each bucket, with V's and N's share of it.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    asked = "bucket int, n int, block bigint, hashes binary, counts binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                train, lengths, _, _, grams = _block(row, order)
                learned = np.repeat(train, lengths)
                for n, (keys, at) in enumerate(zip(grams.keys, grams.at, strict=True), 1):
                    counts = np.bincount(at[learned & (at >= 0)], minlength=len(keys)).astype(np.uint32)
                    bucket = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
                    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.empty(0, np.int64)
                    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True)) if len(cuts) else []
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([n] * len(spans), pa.int32()), pa.array([row["block"]] * len(spans), pa.int64()),
                        pa.array([packed(steps(keys[a:b])) for a, b in spans], pa.binary()), pa.array([packed(counts[a:b]) for a, b in spans], pa.binary()),
                    ], names=["bucket", "n", "block", "hashes", "counts"])

    def add(table: pa.Table) -> pa.Table:
        hashes = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in table["hashes"].to_pylist()]
        counts = np.concatenate([unpacked(x, np.uint32) for x in table["counts"].to_pylist()])
        keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, counts, len(keys)).astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        rows = len(hashes)
        first = table["n"][0].as_py() == 1
        return pa.table({
            "block": table["block"], "n": table["n"], "bucket": table["bucket"],
            "totals": pa.array([packed(x) for x in np.split(total[inverse], ends)], pa.binary()),
            "types": pa.array([int((total > 0).sum()) if first else 0, *[0] * (rows - 1)], pa.int64()),
            "tokens": pa.array([int(total.sum()) if first else 0, *[0] * (rows - 1)], pa.int64()),
        })

    rows = parts.select("block", "train", "lengths", "ids", "vocabulary").mapInArrow(ask, asked)
    told = rows.groupBy("bucket", "n").applyInArrow(add, "block bigint, n int, bucket int, totals binary, types bigint, tokens bigint")
    return told.withColumn("plain", F.lit(None).cast("array<bigint>"))


def totals_by_row(parts: DataFrame, order: int) -> DataFrame:
    """What totals() gives, with a row for each n-gram and block: an aggregation, and a join of its sums back to those who asked.

    A block and a bucket make one packet in totals(), and there are blocks times buckets of them; on inputs so large that
    a packet holds few n-grams, single rows cost less.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                train, lengths, _, _, grams = _block(row, order)
                learned = np.repeat(train, lengths)
                for n, (keys, at) in enumerate(zip(grams.keys, grams.at, strict=True), 1):
                    counts = np.bincount(at[learned & (at >= 0)], minlength=len(keys)).astype(np.int64)
                    for i in range(0, len(keys), 1 << 16):
                        k, c = keys[i : i + (1 << 16)].view(np.int64), counts[i : i + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), pa.array(np.full(len(k), row["block"])), pa.array(np.arange(i, i + len(k))), pa.array(k), pa.array(c)], names=["n", "block", "place", "h", "c"])

    rows = parts.select("block", "train", "lengths", "ids", "vocabulary").mapInArrow(ask, "n int, block bigint, place bigint, h bigint, c bigint")
    sums = stage_table(rows.groupBy("n", "h").agg(F.sum("c").alias("total")), "sums")
    # One block's n-grams are gathered in a row; what they are is bounded by the block's size.
    mine = rows.join(sums, ["n", "h"]).groupBy("block", "n").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("t"))
    told = mine.select("block", "n", F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("totals"), F.col("t.total").alias("plain"), F.lit(0).cast("bigint").alias("types"), F.lit(0).cast("bigint").alias("tokens"))
    seen = sums.where("n = 1").agg(F.count_if(F.col("total") > 0).alias("types"), F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"))
    none = seen.select(F.lit(None).cast("bigint").alias("block"), F.lit(0).alias("n"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("totals"), F.lit(None).cast("array<bigint>").alias("plain"), "types", "tokens")
    return told.unionByName(none)


class Automaton:
    """The states and arcs that a block's texts can reach.

    State 0 is the empty context, state 1 a text's beginning, then follow the contexts that were seen, by order. Arcs are
    sorted by state * words + word. fail and fail_w: each state's failure arc.
    """

    def __init__(self, ids: np.ndarray, grams: Grams, counts: list[np.ndarray], n_all: int, n_types: int, mass: float, share: float):
        order = len(counts)
        self.words = int(ids.max()) + 1 if len(ids) else 1
        self.unknown = -log10(n_all + n_types + 1)
        offset = [2]
        for c in counts[:-1]:
            offset.append(offset[-1] + len(c))
        states = offset[-1]
        self.fail, self.fail_w = np.zeros(states, np.int64), np.zeros(states)
        # An n-gram's first place stands for it.
        first = [np.zeros(len(c), np.int64) for c in counts]
        for n in range(order):
            at = grams.at[n]
            seen = np.flatnonzero(at >= 0)[::-1]
            first[n][at[seen]] = seen
        starts = np.zeros(len(ids), bool)
        starts[grams.starts] = True
        ends = counts[0][grams.at[0][ids == 0][:1]]
        begins = float(ends[0]) if len(ends) else 0.0
        told = mass + share * begins
        self.fail_w[1] = log10(told / (begins + told))
        key, weight, to = [], [], []
        for n in range(order):
            c, place = counts[n], first[n]
            word = ids[place].astype(np.int64)
            if n == 0:
                p = (c + 1) / (n_all + n_types + 1)
                state = np.zeros(len(c), np.int64)
            else:
                begin = starts[place]
                context = np.where(begin, -1, grams.at[n - 1][place - 1])
                held = np.where(begin, begins, counts[n - 1][context])
                told = mass + share * held
                p = (c + told * low[grams.at[n - 1][place]]) / (held + told)  # noqa: F821  low: of the order before
                state = np.where(begin, 1, offset[n - 1] + context)
            if n < order - 1:
                goes = np.where(word == 0, 0, offset[n] + np.arange(len(c)))
                s = slice(offset[n], offset[n] + len(c))
                told = mass + share * c
                self.fail_w[s] = np.log10(told / (c + told))
                self.fail[s] = 0 if n == 0 else offset[n - 1] + grams.at[n - 1][place]
            else:
                goes = np.where(word == 0, 0, offset[n - 1] + grams.at[n - 1][place]) if n else np.zeros(len(c), np.int64)
            there = c > 0
            key.append((state * self.words + word)[there])
            weight.append(np.log10(p[there]))
            to.append(goes[there])
            low = p
        key, weight, to = np.concatenate(key), np.concatenate(weight), np.concatenate(to)
        by = np.argsort(key)
        self.key, self.weight, self.to = np.append(key[by], np.iinfo(np.int64).max), np.append(weight[by], 0.0), np.append(to[by], 0)

    def step(self, state: np.ndarray, word: np.ndarray, into: np.ndarray) -> np.ndarray:
        """The states after reading one word in each of many texts; into gains the weights of the arcs taken."""
        after = np.zeros_like(state)
        left = np.arange(len(state))
        s, w = state, word
        while len(left):
            k = s * self.words + w
            at = np.searchsorted(self.key, k)
            hit = self.key[at] == k
            got = at[hit]
            into[left[hit]] += self.weight[got]
            after[left[hit]] = self.to[got]
            lost = ~hit
            left, s, w = left[lost], s[lost], w[lost]
            root = s == 0
            into[left[root]] += self.unknown
            going = ~root
            left, s, w = left[going], s[going], w[going]
            into[left] += self.fail_w[s]
            s = self.fail[s]
        return after

    def scores(self, ids: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
        """log10 probability of each text. All pieces of all texts advance together, a word at a time."""
        pieces = np.maximum(1, -(-lengths // PIECE))
        owner = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], pieces) + nth * PIECE
        size = np.minimum(PIECE, lengths[owner] - nth * PIECE)
        state = np.where(nth == 0, 1 if order > 1 else 0, 0)
        total, spare = np.zeros(len(owner)), np.zeros(len(owner))
        words = ids.astype(np.int64)
        later = np.flatnonzero(nth > 0)
        for back in range(order - 1, 0, -1):  # the words before a piece lead to its state
            if len(later):
                state[later] = self.step(state[later], words[begin[later] - back], spare[later])
        by = np.argsort(-size, kind="stable")
        begin, size, state, got = begin[by], size[by], state[by], np.zeros(len(by))
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        for t, n in enumerate(live.tolist()):
            state[:n] = self.step(state[:n], words[begin[:n] + t], got[:n])
        total[by] = got
        return np.bincount(owner, total, len(lengths))


def scored(docs: DataFrame, train, key: str = "doc_id", text: str = "text", order: int = ORDER, mass: float = MASS, share: float = SHARE) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of every text; train: a boolean column, what to learn from."""
    parts = stage_table(blocks(docs, key, text, train), "blocks")
    held = parts.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("blocks")).first()
    tokens, in_block = held["tokens"] or 0, (held["tokens"] or 0) / max(held["blocks"], 1)
    buckets = 1 << max(0, int(order * tokens // BUCKET_TOKENS).bit_length())
    packed_up = buckets == 1 or in_block / buckets >= PACKET
    known = stage_table(totals(parts, order, buckets) if packed_up else totals_by_row(parts, order), "totals")
    row = known.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n_all, n_types = row["n"] or 0, row["v"] or 0
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    names = [key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for i in range(block.num_rows):
            row = {c: block[c][i].as_py() for c in ("train", "lengths", "ids", "vocabulary")}
            train, lengths, ids, _, grams = _block(row, order)
            counts: list[list] = [[] for _ in range(order)]
            for k in np.argsort(told["bucket"].to_numpy(), kind="stable").tolist():
                n, data, plain = (told[c][k] for c in ("n", "totals", "plain"))
                counts[n.as_py() - 1].append(unpacked(data.as_py(), np.int64) if data.is_valid else plain.values.to_numpy())
            counts = [np.concatenate(c) if c else np.empty(0, np.int64) for c in counts]
            c = counts[0][grams.at[0]]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            base = np.bincount(owner, np.log10((c + 1) / (n_all + n_types + 1)), len(lengths))
            auto = Automaton(ids, grams, counts, n_all, n_types, mass, share)
            out.append(pa.Table.from_arrays([
                block["keys"].combine_chunks()[i].values, pa.array(train), pa.array(lengths.astype(np.int64)), pa.array(np.bincount(owner, c > 0, len(lengths)).astype(np.int64)),
                pa.array(np.full(len(lengths), n_all)), pa.array(base), pa.array(auto.scores(ids, lengths, order)),
            ], names=names))
        give_back()
        if out:
            return pa.concat_tables(out)
        return block.select([]).slice(0, 0)

    left = parts.select("block", "keys", "train", "lengths", "ids", "vocabulary").groupBy("block")
    right = known.where("block is not null").select("block", "n", "bucket", "totals", "plain").groupBy("block")
    return left.cogroup(right).applyInArrow(score, schema)


def folds(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the fold of remainder 2 in seven is held out."""
    out = scored(docs, crc_bucket("doc_id", 7) != 2, order=order)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
