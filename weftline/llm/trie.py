"""Prefix trie of conversations: distributed MSD radix partitioning over dictionary-encoded turn ids.

Turns, as (role, text), become numbers in the order of their texts; after that only numbers move. Equal conversations become one entry with a count, so copies
cost nothing later. A round takes the buckets that are too large for a task, all at once: entries of a bucket share a prefix; the longest one that they share follows
from the bucket's least and greatest sequence, and gives a chain of nodes; behind it entries are dealt to buckets by their next turn. Buckets of at most LOCAL turns are left to
one task each, which sorts their entries by multikey quicksort and emits a node for each range of entries that share a prefix. Rounds are as many as
branchings lie above one another in large buckets. On the way back, round by round, sums over subtrees go from buckets to the chains above them.

A conversation's turns are ordered by turn (null first), then by role and text; null role or text is empty. Repeated rows are turns of their own. Rows without a conversation are left out.
Conversations without turns are members of the root alone. An empty table has no nodes. Numbers of one conversation's turns are gathered in a row (8 bytes
each); texts are not, however long. Columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import give_back, small_batches, stage_table, together
from weftline.sources.scratch import numbered

#: Turns of a bucket that a task finishes by itself; bytes of ids that are hashed together.
LOCAL, PIECE_BYTES = 1 << 14, 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- sequences -----------------------------------------------------------------------------------------------------


def encoded(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, id, size) of each row, and the dictionary (id, role, text): turns numbered in the order of role and text."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    words = numbered(rows.groupBy("role", "text").agg(F.count("*").alias("times")), [F.col("role"), F.col("text")], "id")
    digest = F.unhex(F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256))
    words = stage_table(words.select("id", "role", "text", digest.alias("digest"), F.length("text").alias("size")), "turns")
    return rows.select("conv_id", "turn", digest.alias("digest")).join(words.select("digest", "id", "size"), "digest").drop("digest"), words


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes) of rows (conv_id, turn, id, size)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "id", "size")))
    return rows.groupBy("conv_id").agg(listed.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 100 instead; h = crc32(c) % 6."""
    heads = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("ids", 1, 5).alias("head"), F.slice("sizes", 1, 5).alias("head_sizes"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(6)).cast("int")
    both = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left")

    def put(own: str, head: str, kind: str) -> Column:
        rest = F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))
        return F.concat(F.slice(F.coalesce(head, F.array().cast(kind)), F.lit(1), F.col("h")), rest)

    return both.select("conv_id", put("ids", "head", "array<bigint>").alias("ids"), put("sizes", "head_sizes", "array<int>").alias("sizes"))


def digests_of_ids(pairs: DataFrame) -> DataFrame:
    """(digest, ends): SHA-256 of each group's conv_ids in ascending order, comma-joined.

    The ids are sorted over all groups together and become texts of some kilobytes within a sorted piece; a group's
    texts pass by one after the other. So a group of any size needs the memory of one text.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, held, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["digest", "first", "part"])

        for batch in batches:
            for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (g != group or size >= PIECE_BYTES):
                    yield out()
                    held, size = [], 0
                if not held:
                    group, first = g, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, h = None, None
        for batch in batches:
            for g, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != group and h is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.binary()), pa.array([h.hexdigest()])], names=["digest", "ends"])
                if g != group:
                    group, h = g, hashlib.sha256(part.encode())
                else:
                    h.update(b"," + part.encode())
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.binary()), pa.array([h.hexdigest()])], names=["digest", "ends"])

    pieces = pairs.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(lambda b: together(join(b)), "digest binary, first bigint, part string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(lambda b: together(digest(b)), "digest binary, ends string")


def entries(convs: DataFrame) -> DataFrame:
    """(ids, sizes, convs, first, ends): the distinct sequences, with the count of their conversations, the least one, and the digest of all."""
    marked = stage_table(convs.withColumn("digest", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))), "sequences")
    each = marked.groupBy("digest").agg(F.count("*").alias("convs"), F.min("conv_id").alias("first"), F.any_value("ids").alias("ids"), F.any_value("sizes").alias("sizes"))
    return each.join(digests_of_ids(marked), "digest").select("ids", "sizes", "convs", "first", "ends")


# --- buckets that a task finishes ------------------------------------------------------------------------------------

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, turn_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, top boolean, up bigint, up_depth bigint"
_NAMES = [f.split()[0] for f in NODE.split(", ")]


def grown(rows: list[dict], depth: int, parent: int) -> list[list]:
    """The nodes of entries that share a prefix of depth + 1 turns: fields of NODE but for the last three, the top node first.

    Multikey quicksort: a range of entries that share d turns is parted by a middle one's next turn; those of equal turn share d + 1 and are a child.
    A range's smaller and greater parts go on at the same depth. Nodes come out before those below them, and sums go up from the last to the first.
    """
    ids = [r["ids"] for r in rows]
    nodes: list[list] = []
    above: list[int] = []
    # (entries, turns shared, index of the node above, whether the entries share the next turn)
    todo = [(list(range(len(rows))), depth, -1, True)]
    while todo:
        some, d, up, same = todo.pop()
        if not same:
            turns = np.array([ids[e][d] for e in some], np.int64)
            middle = np.partition(turns, len(turns) // 2)[len(turns) // 2]
            for part, equal in ((turns > middle, False), (turns < middle, False), (turns == middle, True)):
                if len(at := np.flatnonzero(part)):
                    todo.append(([some[i] for i in at.tolist()], d, up, equal))
            continue
        # A chain down to the last turn that all share.
        last, lasting = min(some, key=lambda e: ids[e]), max(some, key=lambda e: ids[e])
        shared, a, b = d + 1, ids[last], ids[lasting]
        while shared < len(a) and shared < len(b) and a[shared] == b[shared]:
            shared += 1
        n, least = sum(rows[e]["convs"] for e in some), min(rows[e]["first"] for e in some)
        for k in range(d, shared):
            ending = [e for e in some if len(ids[e]) == k + 1] if k + 1 == shared else []
            over = nodes[up][0] if up >= 0 else parent
            nodes.append([least, k + 1, over, a[k], n, 0, 0, (n - 1) * rows[last]["sizes"][k], rows[ending[0]]["ends"] if ending else NO_ENDS])
            above.append(up)
            up = len(nodes) - 1
        if below := [e for e in some if len(ids[e]) > shared]:
            todo.append((below, shared, up, False))
    for i in range(len(nodes) - 1, -1, -1):
        node, up = nodes[i], above[i]
        node[6] = node[6] or 1  # a node without children is a leaf
        if up >= 0:
            nodes[up][5] += 1
            nodes[up][6] += node[6]
            nodes[up][7] += node[7]
    return nodes


def finished(rows: DataFrame) -> DataFrame:
    """The nodes (NODE) of the buckets of rows (up, up_depth, next, ids, sizes, convs, first, ends); up names the chain's last node above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            nodes = grown(held, key[1], key[0])
            columns = list(zip(*nodes, strict=True))
            full = [*columns, [True] + [False] * (len(nodes) - 1), [key[0]] * len(nodes), [key[1]] * len(nodes)]
            kinds = [pa.int64()] * 8 + [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(full, kinds, strict=True)], names=_NAMES)

        for batch in batches:
            for row in batch.to_pylist():
                if (new := (row["up"], row["up_depth"], row["next"])) != key:
                    if held:
                        yield out()
                    key, held = new, []
                held.append(row)
        if held:
            yield out()
        give_back()

    return rows.repartition("up", "up_depth", "next").sortWithinPartitions("up", "up_depth", "next").mapInArrow(lambda b: together(run(b)), NODE)


# --- rounds ------------------------------------------------------------------------------------------------------------


def _shared(a: Column, b: Column) -> Column:
    """The length of the longest prefix of both arrays."""
    k = F.least(F.size(a), F.size(b))
    other = F.array_position(F.zip_with(F.slice(a, F.lit(1), k), F.slice(b, F.lit(1), k), lambda x, y: x != y), True)
    return F.when(other == 0, k).otherwise(other.cast("int") - 1)


def trie(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, turn_id, n_convs, n_children, n_leaves, saved_tokens, ends) of every node of rows (ids, sizes, convs, first, ends)."""
    # A bucket is known by its least conversation and the depth of its first node.
    current = stage_table(seqs.withColumns({"bucket": F.lit(0).cast("bigint"), "d": F.lit(0), "up": F.lit(None).cast("bigint"), "up_depth": F.lit(None).cast("bigint")}), "round")
    chains, left = [], []
    while not current.isEmpty():
        # The least sequence is the chain itself if one ends there.
        heads = current.groupBy("bucket", "d", "up", "up_depth").agg(F.min(F.struct("ids", "sizes", "ends")).alias("low"), F.max("ids").alias("high"), F.sum("convs").alias("n"), F.min("first").alias("first"))
        depth = _shared(F.col("low.ids"), F.col("high"))
        heads = heads.withColumn("depth", depth).withColumn("ends", F.when(F.size("low.ids") == F.col("depth"), F.col("low.ends")).otherwise(NO_ENDS))
        heads = stage_table(
            heads.select("bucket", "d", "up", "up_depth", "first", "n", "depth", "ends", F.slice("low.ids", F.lit(1), F.col("depth")).alias("ids"), F.slice("low.sizes", F.lit(1), F.col("depth")).alias("sizes")), "chains"
        )
        chains.append(heads)
        key = heads.select("bucket", "d", F.col("first").alias("head"), F.col("depth").cast("bigint").alias("at"))
        dealt = current.select("bucket", "d", "ids", "sizes", "convs", "first", "ends").join(key, ["bucket", "d"]).where(F.size("ids") > F.col("at"))
        dealt = dealt.withColumn("next", F.get("ids", F.col("at").cast("int")))
        dealt = stage_table(dealt.select(F.col("head").alias("up"), F.col("at").alias("up_depth"), "next", "ids", "sizes", "convs", "first", "ends"), "dealt")
        size = F.sum(F.size("ids") - F.col("up_depth"))
        large = dealt.groupBy("up", "up_depth", "next").agg(size.alias("turns"), F.count("*").alias("n"), F.min("first").alias("bucket")).where((F.col("turns") > local) & (F.col("n") > 1))
        large = stage_table(large.select("up", "up_depth", "next", "bucket"), "large")
        on = ["up", "up_depth", "next"]
        left.append(dealt.join(large, on, "left_anti").select(*dealt.columns))
        current = stage_table(dealt.join(large, on).select("ids", "sizes", "convs", "first", "ends", "bucket", (F.col("up_depth") + 1).cast("int").alias("d"), "up", "up_depth"), "round")
    if not chains:
        return finished(seqs.select(F.lit(0).cast("bigint").alias("up"), F.lit(0).cast("bigint").alias("up_depth"), F.lit(0).cast("bigint").alias("next"), *seqs.columns)).drop("top", "up", "up_depth")
    rows = left[0]
    for more in left[1:]:
        rows = rows.unionByName(more)
    below = stage_table(finished(rows), "nodes")
    tops = stage_table(below.where("top").groupBy("up", "up_depth").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")), "tops")
    out, sums = [below.drop("top", "up", "up_depth")], tops
    for heads in reversed(chains):
        # What lies under a chain: buckets that tasks finished, and chains of the next round.
        under = sums.select(F.col("up").alias("first"), F.col("up_depth").cast("int").alias("depth"), "c", "l", "s")
        full = heads.join(under, ["first", "depth"], "left").withColumns({"c": F.coalesce("c", F.lit(0)), "s": F.coalesce("s", F.lit(0))})
        full = full.withColumn("l", F.when(F.col("c") == 0, 1).otherwise(F.col("l")))
        # saved[k]: from the chain's node of depth k down. The root has no text.
        own = F.transform(F.sequence(F.col("d"), F.col("depth")), lambda k: F.when(k == 0, F.lit(0).cast("bigint")).otherwise((F.col("n") - 1) * F.get("sizes", k - 1)))
        full = stage_table(full.withColumn("own", own), "sums")
        # Running sums from the chain's last node up, a pass over the array.
        suffix = F.reverse(F.aggregate(F.reverse("own"), F.struct(F.array().cast("array<bigint>").alias("a"), F.col("s").alias("t")), lambda acc, x: F.struct(F.array_append(acc["a"], acc["t"] + x).alias("a"), (acc["t"] + x).alias("t")), lambda acc: acc["a"]))
        nodes = full.withColumn("saved", suffix).select("*", F.posexplode("saved").alias("i", "saved_tokens")).withColumn("k", F.col("d") + F.col("i"))
        last = F.col("k") == F.col("depth")
        parent = F.when(F.col("k") == 0, F.lit(None)).when(F.col("i") == 0, F.col("up")).otherwise(F.col("first"))
        out.append(nodes.select(
            F.col("first").alias("conv_id"), F.col("k").cast("bigint").alias("depth"), parent.cast("bigint").alias("parent_conv_id"), F.when(F.col("k") > 0, F.get("ids", F.col("k") - 1)).alias("turn_id"),
            F.col("n").alias("n_convs"), F.when(last, F.col("c")).otherwise(1).cast("bigint").alias("n_children"), F.col("l").cast("bigint").alias("n_leaves"), "saved_tokens", F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends"),
        ))
        up = full.where("up is not null").groupBy("up", "up_depth").agg(F.count("*").alias("c"), F.sum("l").alias("l"), F.sum(F.col("s") + F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("s"))
        sums = stage_table(tops.unionByName(up).groupBy("up", "up_depth").agg(F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s")), "sums")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def nodes(conversations: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """The trie of rebuilt conversations, and the dictionary (id, role, text, ...) of its turns."""
    rows, words = encoded(small_batches(conversations))
    return trie(stage_table(entries(rebuilt(stage_table(sequences(rows), "convs"))), "entries"), local), words


def digests(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes as conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    return nodes(conversations, local)[0].select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


#: The polynomial of CRC-32, a bit at a time: seven empty steps follow each byte.
DIGESTS_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'x': x} ORDER BY turn NULLS FIRST, role, x) AS q FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, q, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 6 AS h FROM own
),
seq AS (SELECT c.conv_id, list_concat(coalesce(b.q, [])[1:c.h], c.q[c.h + 1:]) AS q FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
mem AS (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS depth FROM seq),
node AS (
  SELECT depth, q[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(q) = depth), '') AS e,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * coalesce(length(any_value(q[depth].x)), 0) END AS saved
  FROM mem GROUP BY depth, q[1:depth]
),
kids AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (depth, p)),
sub AS (SELECT depth, p, sum(saved)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves FROM (SELECT a AS depth, p[1:a] AS p, saved, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_)) GROUP BY ALL)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.e) AS ends_sha256
FROM full_ f JOIN sub s ON f.depth = s.depth AND f.p = s.p LEFT JOIN node up ON up.depth = f.depth - 1 AND up.p = f.p[1:f.depth - 1]
"""
