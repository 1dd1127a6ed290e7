"""Exact near-duplicate links of embeddings by a metric range join.

cosine >= c is a distance of at most r = sqrt(2 - 2c) between unit vectors. Pivots drawn from a label's vectors
part them into cells, each vector's home being its nearest pivot and, in steps of 2 r, its distance from it. By the triangle
inequality whatever lies within r of a vector has its home at a pivot at most 2 r farther than the vector's own
nearest, and in a step within r of the vector's distance; the vector is sent to those cells as a candidate, and the cells are
joined independently, homes against candidates, in double precision. Every vector thus meets all its
partners in the cells of the partners' homes, whatever pivots were drawn.

Vectors that are null, zero, or hold null or non-finite components, and rows without label or vec_id, link with
nothing. Vectors of another length never link. Every row is a vector, whatever its vec_id: equal vectors of a label are joined once
and counted as often as they stand, and so are the rows of one vec_id. In components the rows of one vec_id
are one node. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, stage_table

#: Homes or candidates in one task; a larger cell is dealt out as homes' parts times candidates' parts.
PART_ROWS = 4096
#: Pivots of a label at most: beyond, cells grow and are dealt out in more parts, with the same links.
MOST_PIVOTS = 1024
#: Vectors of a label in one task while cells are assigned.
ASSIGN_ROWS = 65536


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distinct(vectors: DataFrame) -> DataFrame:
    """(label, v, node, copies, nr) of the vectors that can link: node the least vec_id of equal ones, nr a number of the vector's own."""
    good = vectors.where("vec_id is not null and label is not null and size(embedding) > 0").select("label", F.col("embedding").cast("array<double>").alias("v"), "vec_id")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    return good.where(F.coalesce(finite, F.lit(False))).groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("nr", F.monotonically_increasing_id())


def _assigned(each: DataFrame, radius: float) -> DataFrame:
    """(label, dim, pivot, step, home, node, copies, nr, v): each vector at home once, and as a candidate wherever partners can be."""
    each = each.withColumn("dim", F.size("v"))
    counts = each.groupBy("label", "dim").agg(F.count("*").alias("n")).select(
        "label", "dim", F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(MOST_PIVOTS)).cast("int").alias("pivots"), F.ceil(F.col("n") / ASSIGN_ROWS).cast("int").alias("salts")
    )
    rows = each.join(counts, ["label", "dim"]).withColumn("h", F.xxhash64("v"))
    drawn = rows.groupBy("label", "dim", "salts", F.pmod("h", "pivots").alias("slot")).agg(F.min_by("v", F.struct("h", "node")).alias("v"))
    sent = drawn.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("slot").cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("nr"), "v")
    own = rows.select("label", "dim", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("node").cast("long"), "copies", "nr", "v")
    dealt = sent.unionByName(own).repartition("label", "dim", "salt").sortWithinPartitions("label", "dim", "salt", "kind", "node")
    schema = f"label {each.schema['label'].dataType.simpleString()}, dim int, pivot int, step int, home boolean, node bigint, copies bigint, nr bigint, v array<double>"
    names = ["label", "dim", "pivot", "step", "home", "node", "copies", "nr", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, np.empty((0, 0))
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            kinds = batch.column(3).to_numpy()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]]
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[s] != key:
                    key, pivots = keys[s], np.empty((0, keys[s][1]))
                x = _matrix(batch.column(7).slice(s, e - s))
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                if kinds[s] == 0:
                    pivots = np.concatenate([pivots, x])
                    continue
                for i in range(0, len(x), 2048):
                    part = batch.slice(s + i, min(2048, len(x) - i))
                    d = np.sqrt(np.maximum(0, 2 - 2 * x[i : i + 2048] @ pivots.T))
                    near = d.argmin(1)
                    at = np.arange(len(d))
                    slack = 1e-6  # far above the rounding of d
                    row, pivot = np.nonzero(d <= d[at, near][:, None] + 2 * radius + slack)
                    low = np.maximum(0, np.floor((d[row, pivot] - radius - slack) / (2 * radius))).astype(np.int32)
                    more = np.floor((d[row, pivot] + radius + slack) / (2 * radius)).astype(np.int32) > low
                    rows = np.concatenate([at, row, row[more]])
                    cell = np.concatenate([near, pivot, pivot[more]]).astype(np.int32)
                    step = np.concatenate([np.floor(d[at, near] / (2 * radius)).astype(np.int32), low, low[more] + 1])
                    home = np.arange(len(rows)) < len(at)
                    for k in range(0, len(rows), 8192):
                        c = slice(k, k + 8192)
                        took = part.take(pa.array(rows[c]))
                        yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(cell[c]), pa.array(step[c]), pa.array(home[c]), took.column(4), took.column(5), took.column(6), took.column(7)], names=names)

    return dealt.mapInArrow(run, schema)


def links(vectors: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors (label, v, node, copies, nr), and (nr, node, to, found): links found by a vector (to null), or an edge node-to; edges connect what is linked."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    each = stage_table(_distinct(vectors), "vectors")
    cells = stage_table(_assigned(each, radius), "cells")
    cell = ["label", "dim", "pivot", "step"]
    sizes = cells.groupBy(*cell).agg(
        F.ceil(F.count_if("home") / PART_ROWS).cast("int").alias("hs"), F.ceil(F.count_if(~F.col("home")) / PART_ROWS).cast("int").alias("cs")
    ).where("hs > 0")
    dealt = cells.join(sizes, cell)
    pick = lambda n: F.pmod(F.xxhash64("nr"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = dealt.where("home").withColumn("hp", pick("hs")).withColumn("cp", all_of("cs"))
    others = dealt.where("not home").withColumn("cp", pick("cs")).withColumn("hp", all_of("hs"))
    tasks = homes.unionByName(others).select(*cell, "hp", "cp", "home", "node", "copies", "nr", "v")

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        home = table["home"].to_numpy()
        node, copies, nr, x = *(table[c].to_numpy() for c in ("node", "copies", "nr")), _matrix(table["v"].combine_chunks())
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        found = np.zeros(len(node), np.int64)
        ids, of = np.unique(node, return_inverse=True)
        root = np.arange(len(ids))
        for i in range(0, len(a), 256):
            part = a[i : i + 256]
            near = (x[part] @ x[b].T >= cosine) & (nr[part][:, None] != nr[b][None])
            found[part] = near @ copies[b]
            for q in np.flatnonzero(near.any(1)):
                met = np.unique(np.append(root[of[b[near[q]]]], root[of[part[q]]]))
                if len(met) > 1:
                    root[np.isin(root, met)] = met[0]
        joined = np.flatnonzero(root != np.arange(len(ids)))
        counted = a[found[a] > 0]
        blank = lambda n: pa.nulls(n, pa.int64())
        return pa.table({
            "nr": pa.concat_arrays([pa.array(nr[counted]), blank(len(joined))]),
            "node": pa.concat_arrays([blank(len(counted)), pa.array(ids[joined])]),
            "to": pa.concat_arrays([blank(len(counted)), pa.array(ids[root[joined]])]),
            "found": pa.concat_arrays([pa.array(found[counted]), blank(len(joined))]),
        })

    pairs = tasks.groupBy(*cell, "hp", "cp").applyInArrow(join, "nr bigint, node bigint, to bigint, found bigint")
    return each, stage_table(pairs, "links")


def groups(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    each, found = links(vectors, cosine)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    # Where an id has several vectors, their nodes are one.
    several = stage_table(vectors.where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id"), "several")
    edges = found.where("to is not null").select("node", "to")
    if not several.isEmpty():
        edges = edges.unionByName(rows.join(several, "vec_id").join(each, ["label", "v"]).select(F.col("vec_id").cast("long").alias("node"), F.col("node").cast("long").alias("to")).distinct())
    comp = components(edges, "node", "to")
    counts = found.where("nr is not null").groupBy("nr").agg(F.sum("found").alias("found"))
    named = each.join(counts, "nr", "left").select("label", "v", "node", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n"))
    # By way of the vector's node; an id whose vectors are all blank is no node and its own component.
    out = rows.join(named, ["label", "v"], "left").withColumn("node", F.coalesce(F.col("node").cast("long"), F.col("vec_id").cast("long")))
    return out.join(comp, "node", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
