"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints are compared in buckets: there they stand as vertical bit planes, carry-save counters count the differing
bits of 64 of them at once, and a block of 64 is abandoned once all its counters are past the radius.

groups(): fingerprints of 64 bits within `radius` bits of each other. Two such agree on at least two of
radius + 2 blocks, so every pair of blocks is one table of buckets, and all links lie in buckets. Null and empty texts,
and those without words, have fingerprint zero and link like any other. Repeated rows share a fingerprint, of which one is
compared. A row without an id takes its fingerprint's component, null if no row with an id is in it.

similar(), kept(): texts whose sets of WORDS-word shingles have a Jaccard similarity of SIMILAR or more. That is far apart in
bits, so the fingerprints are wide (64 * WIDE bits over the set of shingles) and buckets are bands of least shingle hashes, which a pair
at SIMILAR shares but for a probability of (1 - SIMILAR ** ROWS) ** BANDS, 3e-6. Texts within RADIUS bits of each other in a bucket
are in one candidate group; a pair at SIMILAR is within it but for 5 standard deviations. In a candidate group an inverted index of its
members' shingles counts what they share, exactly; no pair of a group is written down, links come as
a few edges that connect what is linked. In buckets and groups too large for one task every member is first held against one of them,
and only those that it is not like are then held against all, in parts. Texts of equal words are one node from the start; null and empty texts,
and those without words, are equal. Texts of up to WORDS words are one shingle. Rows without an id are in no group.

Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftline.llm.common import apart, by_bytes, components, give_back, named, small_batches, stage_table, without

#: Rows of a bucket compared in one task; a larger bucket is dealt out as pairs of parts.
PART_ROWS = 2048
BATCH_BYTES = 1 << 20
#: Near duplicates by similarity: words of a shingle, least similarity, words of 64 bits of a fingerprint and its radius, bands and their rows.
WORDS, SIMILAR, WIDE, RADIUS, BANDS, ROWS = 5, 0.8, 4, 76, 32, 5
#: Shingles of a candidate group verified in one task; a larger group is dealt out.
PART_SHINGLES = 1 << 21
_RNG = np.random.default_rng(8)
_XOR, _TIMES, _MIX, _ADD = (_RNG.integers(0, 1 << 64, n, np.uint64) for n in (BANDS * ROWS, BANDS * ROWS, BANDS * ROWS, WIDE))
_TIMES |= np.uint64(1)
_MIX |= np.uint64(1)


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of one text, as an unsigned number."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else (b" ".join(w),)
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp the fingerprint's bits as a signed long."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BATCH_BYTES):
                fp = np.array([fingerprint(t or b"", words) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])
        give_back()

    return small_batches(docs).select(key, F.col(text).cast("string").cast("binary").alias("b")).mapInArrow(run, schema)


def _planes(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of fp (rows, words): one row of words for each of bits, one bit a fingerprint."""
    filled = np.concatenate([fp, np.zeros((-len(fp) % 64, fp.shape[1]), np.uint64)])
    each = np.unpackbits(filled.view(np.uint8).reshape(len(filled), -1), axis=1, bitorder="little")
    return np.packbits(each.T[bits], axis=1, bitorder="little").view(np.uint64)


def _near(queries: np.ndarray, planes: np.ndarray, bits: list[int], radius: int) -> np.ndarray:
    """(query, lane) -> whether they differ in at most radius of bits; queries: (queries, words).

    Counters hold one word for each bit of the count. They begin at what makes them run over when radius is passed.
    """
    levels, words = max(radius.bit_length(), 1), planes.shape[1]
    full, spare = ~np.uint64(0), (1 << levels) - 1 - radius
    q, w = np.repeat(np.arange(len(queries)), words), np.tile(np.arange(words), len(queries))
    over = np.zeros(len(q), np.uint64)
    count = [np.full(len(q), full if spare >> level & 1 else 0, np.uint64) for level in range(levels)]
    for k, bit in enumerate(bits):
        flip = np.where((queries[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1), full, np.uint64(0))
        carry = planes[k][w]
        carry ^= flip[q]
        for c in count:
            nxt = c & carry
            c ^= carry
            carry = nxt
        over |= carry
        if k % 8 == 7:  # blocks whose lanes are all past the radius are done
            going = over != full
            if 10 * np.count_nonzero(going) < 9 * len(going):
                q, w, over, count = q[going], w[going], over[going], [c[going] for c in count]
                if not len(q):
                    break
    out = np.zeros((len(queries), words), np.uint64)
    out[q, w] = ~over
    return np.unpackbits(out.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").astype(bool)


def _join(root: np.ndarray, members: np.ndarray) -> None:
    """One component of the members' components."""
    met = np.unique(root[members])
    if len(met) > 1:
        root[np.isin(root, met)] = met[0]


def local_components(fp: np.ndarray, radius: int, homes: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """For each of fp (rows, words), the index of the first member of its component among them.

    homes: which rows are compared with all; all by default. sizes: link only where the lesser is SIMILAR of the larger at least.
    """
    n, root = len(fp), np.arange(len(fp))
    spread = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [b for b in range(64 * fp.shape[1]) if int(spread[b // 64]) >> (b % 64) & 1]
    if len(bits) <= radius and sizes is None and homes is None:
        return np.zeros(n, np.int64)
    planes = _planes(fp, bits) if bits else np.empty((0, -(-n // 64)), np.uint64)
    asked = np.arange(n) if homes is None else np.flatnonzero(homes)
    for i in range(0, len(asked), 64):
        part = asked[i : i + 64]
        near = _near(fp[part], planes, bits, radius)[:, :n]
        if sizes is not None:
            near &= np.minimum(sizes[part][:, None], sizes) >= SIMILAR * np.maximum(sizes[part][:, None], sizes)
        for q in np.flatnonzero(near.sum(1) > 1):
            _join(root, near[q])
    return root


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches by groups: rows that agree in their first `keys` columns, numbers."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:keys]], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (key[a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) edges between nodes of fps (node, fp; fp distinct) whose components are those of all links."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in pair) for pair in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = fps.select("node", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("t", "k"))
    sizes = keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        keys.join(sizes, ["t", "k"]).withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")
    )
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp")
    kind = fps.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: np.ndarray, node: np.ndarray, fp: np.ndarray):
            """Edges of the groups of rows; pairs stand alone so often that all of them are compared as lanes of one word list."""
            first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)])
            size = np.diff(np.r_[first, len(group)])
            two = first[size == 2]
            if len(two):
                x = fp[two] ^ fp[two + 1]
                near = _near(np.zeros((1, 1), np.uint64), _planes(x[:, None], list(range(64))), list(range(64)), radius)[0, : len(two)]
                yield node[two[near]], node[two[near] + 1]
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                root = local_components(fp[s : s + n, None], radius)
                at = np.flatnonzero(root != np.arange(n))
                yield node[s + at], node[s + root[at]]

        held: list[np.ndarray] = []
        for batch in batches:
            group = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], 1)
            new = [group, batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy().view(np.uint64)]
            if held:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = np.flatnonzero((new[0] != new[0][-1]).any(1))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            held = [x[cut:] for x in new]
            if cut:
                for a, b in done(*(x[:cut] for x in new)):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held:
            for a, b in done(*held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id a long)."""
    fps = stage_table(fingerprints(docs, words), "fingerprints")
    each = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(each.where("node is not null"), radius))
    named = each.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- by similarity -------------------------------------------------------------------------------------------------


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word shingles; none where there are no words."""
    if not words:
        return np.empty(0, np.uint64)
    made = {b" ".join(words)} if len(words) <= size else set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    h = np.fromiter(map(xxh64_intdigest, made, repeat(42)), np.uint64, len(made))
    h.sort()
    return h


def wide(h: np.ndarray) -> np.ndarray:
    """WIDE words: a bit is 1 if it is set in over half of the shingles' mixed hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), 1 << 12):
        x = h[i : i + (1 << 12), None] + _ADD
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(times)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """One key for each band of the least values of the shingles' hashes, as signed longs."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(h), 1 << 10):
        np.minimum(least, ((h[None, i : i + (1 << 10)] ^ _XOR[:, None]) * _TIMES[:, None]).min(1), out=least)
    return ((least ^ (least >> np.uint64(29))) * _MIX).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def digest(text: Column) -> Column:
    """What _signatures() makes of a text's words: equal for equal words."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(F.btrim(F.regexp_replace(lower, "[\\x20\\x09-\\x0D]+", " "), F.lit(" ")).cast("binary")))


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, fp, keys) of every row with an id: digest of the words, number of shingles, fingerprint, bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BATCH_BYTES):
                digests, sizes, fps, keys = [], [], [], []
                for t in part.column(1).to_pylist():
                    w = t.lower().split()
                    h = shingles(w)
                    digests.append(md5(b" ".join(w)).digest())
                    sizes.append(len(h))
                    fps.append(wide(h).view(np.int64))
                    keys.append(bands(h) if len(h) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "fp", "keys"]
                )
        give_back()

    texts = small_batches(docs).where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("b"))
    return texts.mapInArrow(run, f"doc_id {kind}, digest binary, n bigint, fp array<bigint>, keys array<bigint>")


def _dealt(rows: DataFrame, key: str, attached: DataFrame | None, sort: str) -> DataFrame:
    """rows (key, parts, node, ...) by task: (key, hp, cp, kind, ...).

    A key of one part is one task, and all its rows are kind 0. In a larger one homes (kind 1) are the rows that are not in
    attached (key, node); each part of them meets each part of all rows (kind 2).
    """
    one = rows.where("parts = 1").withColumns({"hp": F.lit(0), "cp": F.lit(0), "kind": F.lit(0)})
    tasks = one
    if attached is not None:
        many = rows.where("parts > 1")
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        homes = many.join(attached, [key, "node"], "left_anti").withColumn("hp", own).withColumn("cp", every).withColumn("kind", F.lit(1))
        # Only the parts of homes that are there need partners.
        need = homes.select(key, "hp").distinct()
        others = many.join(need, key).withColumn("cp", own).withColumn("kind", F.lit(2))
        tasks = one.unionByName(homes.select(*one.columns)).unionByName(others.select(*one.columns))
    rest = [c for c in rows.columns if c not in (key, "parts")]
    tasks = tasks.select(key, "hp", "cp", "kind", *rest)
    return tasks.repartition(key, "hp", "cp").sortWithinPartitions(key, "hp", "cp", sort)


def _candidates(nodes: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are near another one's fingerprint."""
    keys = nodes.select("node", F.explode("keys").alias("k"))
    buckets = keys.groupBy("k").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x")).where("c > 1")
    # Copies share most of their bands: of buckets with the same members one is enough.
    shared = buckets.groupBy("c", "low", "high", "x").agg(F.min("k").alias("k")).select("k", F.ceil(F.col("c") / PART_ROWS).cast("int").alias("parts"))
    held = stage_table(keys.join(shared, "k"), "shared")
    rows = stage_table(held.join(nodes.select("node", "n", "fp"), "node"), "buckets")
    near = lambda n: F.least("n", n) >= SIMILAR * F.greatest("n", n)
    edges, attached = [], None
    large = rows.where("parts > 1")
    if not large.isEmpty():
        pivots = large.groupBy("k").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("to"), F.col("n").alias("m"), F.col("fp").alias("of"))).alias("p")).select("k", "p.to", "p.m", "p.of")
        apart = reduce(Column.__add__, (F.bit_count(F.get("fp", F.lit(i)).bitwiseXOR(F.get("of", F.lit(i)))) for i in range(WIDE)))
        attached = stage_table(large.join(pivots, "k").where((apart <= RADIUS) & near("m")).select("k", "node", "to"), "attached")
        edges.append(attached.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            kind, node, n = (table[c].to_numpy() for c in ("kind", "node", "n"))
            fp = table["fp"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), WIDE)
            if len(node) == 2 and np.bitwise_count(fp[0] ^ fp[1]).sum() > RADIUS:
                continue
            root = local_components(fp, RADIUS, kind < 2 if kind.any() else None, n)
            at = np.flatnonzero(root != np.arange(len(node)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], names=["a", "b"])

    edges.append(_dealt(rows, "k", None if attached is None else attached.select("k", "node"), "node").mapInArrow(run, "a bigint, b bigint"))
    return components(reduce(DataFrame.unionByName, edges))


def alike(sets: list[np.ndarray], least: float, homes: np.ndarray | None = None) -> np.ndarray:
    """For each of sets (sorted distinct hashes), the index of the first member of its component by Jaccard similarity.

    An inverted index counts what a set shares with all. Sets that a star's centre is linked to are asked only if there is more than
    one component, those of the one that is largest then not at all: links between components are found from the other end. homes: which sets
    are asked; all by default.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(n), sizes)[np.argsort(inverse, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(inverse))]
    root, done = np.arange(n), np.zeros(n, bool)

    def ask(i: int) -> np.ndarray:
        own = inverse[ends[i] - sizes[i] : ends[i]]
        runs = first[own + 1] - first[own]
        at = np.arange(runs.sum()) + np.repeat(first[own] - np.cumsum(runs) + runs, runs)
        both = np.bincount(holders[at], minlength=n)
        linked = both / np.maximum(sizes + sizes[i] - both, 1) >= least
        _join(root, np.append(np.flatnonzero(linked), i))
        return linked

    asked = np.arange(n) if homes is None else np.flatnonzero(homes)
    met = np.zeros(n, bool)
    for i in asked.tolist():
        if not met[i]:
            met |= ask(i)
            done[i] = True
    found, counts = np.unique(root, return_counts=True)
    anchor = int(found[counts.argmax()]) if n else 0  # one member of the component that is the largest now
    for i in asked[~done[asked]].tolist():
        if homes is not None or root[i] != root[anchor]:
            ask(i)
    return root


def _verified(docs: DataFrame, nodes: DataFrame, groups_of: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(node, component) of the nodes that are linked: candidates whose shingles are SIMILAR."""
    members = stage_table(groups_of.join(nodes.select("node", "digest", "first", "n"), "node"), "members")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("b"))
    wanted = members.select(F.col("first").alias("doc_id"), "digest", "node", F.col("component").alias("g"))
    texts = apart(texts, wanted.select("doc_id"), "doc_id")[0].join(wanted, "doc_id").select("doc_id", "b", "digest", "node", "g")

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BATCH_BYTES):
                at, sets = [], []
                for i, (t, d) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    w = t.lower().split()
                    if md5(b" ".join(w)).digest() == d:  # an id may have other texts too
                        at.append(i)
                        sets.append(shingles(w).tobytes())
                took = part.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([took.column(4), took.column(3), pa.array(sets, pa.binary())], names=["g", "node", "set"])
        give_back()

    sets = texts.mapInArrow(hash_all, "g bigint, node bigint, set binary")
    if repeated is not None:
        sets = sets.groupBy("g", "node").agg(F.min("set").alias("set"))
    sizes = members.groupBy(F.col("component").alias("g")).agg(F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    rows = stage_table(sets.join(sizes, "g"), "sets")
    edges, attached = [], None
    large = rows.where("parts > 1")
    if not large.isEmpty():
        pivots = large.groupBy("g").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("to"), F.col("set").alias("of"))).alias("p")).select("g", "p.to", "p.of")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for i in range(batch.num_rows):
                    a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (3, 4))
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(both / max(len(a) + len(b) - both, 1) >= SIMILAR)
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good, pa.bool_())).columns[:3], names=["g", "node", "to"])

        attached = stage_table(large.join(pivots, "g").select("g", "node", "to", "set", "of").mapInArrow(compare, "g bigint, node bigint, to bigint"), "attached")
        edges.append(attached.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            kinds, node = table["kind"].to_numpy(), table["node"].to_numpy()
            root = alike([np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]], SIMILAR, kinds < 2 if kinds.any() else None)
            at = np.flatnonzero(root != np.arange(len(node)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], names=["a", "b"])
        give_back()

    tasks = _dealt(rows, "g", None if attached is None else attached.select("g", "node"), "node")
    edges.append(tasks.mapInArrow(verify, "a bigint, b bigint"))
    return components(reduce(DataFrame.unionByName, edges).where("a <> b"))


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Near duplicates of docs (doc_id, text): rows, nodes, repeated.

    rows: (doc_id, digest) of every row with an id. nodes: (digest, first, copies, top_id, top_digest), a row for each kind of
    text: its least doc_id, its number of rows, and the least doc_id of its group with that one's digest. repeated: the ids of more than one
    row, None if there is none.
    """
    signed = stage_table(_signatures(docs), "signatures")
    many = stage_table(signed.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    repeated = None if many.isEmpty() else many
    each = signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min(F.struct("n", "fp", "keys")).alias("s"))
    # The numbers are fixed by being written.
    nodes = stage_table(each.select("digest", "first", "copies", "s.*", F.monotonically_increasing_id().alias("node")), "nodes")
    linked = _verified(docs, nodes, _candidates(nodes), repeated)
    found = nodes.select("digest", "first", "copies", "node").join(linked, "node", "left").withColumn("c", F.coalesce("component", "node"))
    tops = found.where("component is not null").groupBy("c").agg(F.min(F.struct("first", "digest")).alias("top"))
    named_all = found.join(tops, "c", "left").select("digest", "first", "copies", F.coalesce("top.first", "first").alias("top_id"), F.coalesce("top.digest", "digest").alias("top_digest"))
    return signed.select("doc_id", "digest"), stage_table(named_all, "groups"), repeated


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row of docs: the least doc_id of its near duplicates; rows without an id have none."""
    rows, nodes, _ = similar(docs)
    named_all = rows.join(nodes.select("digest", F.col("top_id").alias("component_id")), "digest").select("doc_id", "component_id")
    return named_all.unionByName(docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("component_id")))


def kept(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the least doc_id; rows without an id all stay. Columns stay.

    An id with different texts stands in the group of each; of rows with equal ids and words any one stays. The rows that go are written
    first, and only texts that may be among them are moved.
    """
    rows, nodes, repeated = similar(docs)
    lost = nodes.where((F.col("copies") > 1) | (F.col("digest") != F.col("top_digest"))).select("digest", F.when(F.col("digest") == F.col("top_digest"), F.col("first")).alias("stays"))
    gone = stage_table(rows.join(lost, "digest").where("stays is null or doc_id <> stays").select("doc_id", "digest").distinct(), "gone")
    if repeated is None:
        return without(docs, gone.select("doc_id"), "doc_id")
    mark = "\x00digest"
    single = without(docs, stage_table(gone.select("doc_id").unionByName(repeated).distinct(), "gone"), "doc_id")
    several = apart(docs, repeated, "doc_id")[0].join(repeated, "doc_id", "left_semi").withColumn(mark, digest(F.col("text"))).dropDuplicates(["doc_id", mark])
    return single.unionByName(several.join(gone.withColumnRenamed("digest", mark), ["doc_id", mark], "left_anti").select(*named(docs)))
