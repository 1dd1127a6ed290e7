"""Shared helpers: the scratch folder, byte-bounded batches, samples and components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset, a temporary one, but only if all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="weftline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends at replicated files."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about limit bytes in column (a single longer row stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def together(batches: Iterator[pa.RecordBatch], rows: int = 1024, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: up to `rows` rows, or about `limit` bytes."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """df, with Arrow batches of at most `rows` rows unless the session says otherwise: texts are long, and Spark counts rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(rows))
    return df


def give_back() -> None:
    """Free memory to the system at the end of a task: Spark keeps its Python workers for the stages to come."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc_bucket(column: str, m: int):
    """crc32 of a column's text modulo m; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(m))


def named(df: DataFrame, without: tuple = ()) -> list[Column]:
    """df's columns but for some, quoted: a name may hold dots."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in without]


#: Slots of a hashed set of keys at most: 4 MB of bits, whatever the number of keys.
SLOTS = 1 << 25
_PAGE = 1 << 15  # bits of Spark's bitmaps


def apart(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df in two: the rows whose key may stand in keys (key; a written table), and those whose key does not.

    So a join with keys needs to move the first part alone. A hashed set of the keys, at most SLOTS bits and therefore
    always sent to every task, tells them apart; with so many keys that it is full, all rows are in the first part.
    """
    slots = min(SLOTS, max(_PAGE, 1 << (16 * keys.count()).bit_length()))
    slot = F.xxhash64(key).bitwiseAND(F.lit(slots - 1))
    page, bit = F.shiftright(slot, 15).cast("int"), slot.bitwiseAND(F.lit(_PAGE - 1))
    # Brought together before they are summed up, as a part of the sum is as large as the whole.
    sets = keys.select(page.alias("_page"), bit.alias("_bit")).repartition("_page").groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("\x00bits"))
    byte = F.conv(F.hex(F.substring("\x00bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    marked = df.withColumn("\x00page", page).join(F.broadcast(stage_table(sets, "set").withColumnRenamed("_page", "\x00page")), "\x00page", "left").withColumn("\x00found", found)
    return marked.where("`\x00found`").select(*named(df)), marked.where("not `\x00found`").select(*named(df))


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df but for the rows whose key stands in keys (key; a written table); rows without a key stay."""
    some, rest = apart(df, keys, key)
    return rest.unionByName(some.join(keys, key, "left_anti").select(*named(df)))


def mapped(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with numbered names on the way: mapInArrow itself can't take names with dots."""
    names = [f"c{i}" for i in range(len(schema))]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    out = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(numbered, T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema, strict=True)]))
    return out.toDF(*schema.names)


def beside(df: DataFrame, text: str, made: tuple, whole: bool) -> tuple[DataFrame, list[str], int]:
    """The rows for a pass that adds the columns `made`: df with text as a string, the names that stay, and text's place.

    Text stands last and goes unless whole; columns named like made ones go.
    """
    stay = [c for c in df.columns if c not in made and (whole or c != text)]
    rows = df.withColumn(text, F.col(text).cast("string")).select(*named(df, (text, *made)), F.col(text))
    return rows, [c for c in rows.columns if c in stay], len(rows.columns) - 1


def hashed_sample(keys: DataFrame, key: str, n: int, group: str) -> list[tuple]:
    """(group, key) of at most n rows of keys for each group, those of the least hash of key.

    A key stands in one row of keys. Only its rows of low hash leave the executors, twice as many as wanted on
    average: what share of the hashes that is follows from the group's size.
    """
    counts = keys.groupBy(group).agg(F.count("*").alias("_size"))
    share = F.xxhash64(key).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(1 << 30)
    picked = keys.join(counts, group).where(share <= F.lit(2.0 * n + 20) / F.col("_size")).select(group, key, F.xxhash64(key).alias("_h"))
    by: dict = defaultdict(list)
    for g, k, h in picked.collect():
        by[g].append((h & ((1 << 30) - 1), h, k))
    return [(g, k) for g in sorted(by) for _, _, k in sorted(by[g])[:n]]


def spread(text: Column, most: int = 16384, parts: int = 16) -> Column:
    """text, or of one of more than `most` characters `parts` pieces that lie evenly over all of it, `most` characters together."""
    at = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, (i * (F.length(text) - most // parts) / (parts - 1)).cast("int") + 1, F.lit(most // parts)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(at, " "))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the least node.

    Rounds of contraction. Each round takes every node's least neighbour (a partial
    aggregation, so a hub costs one row a task), follows those pointers to their
    roots, renames the edges and drops the ones that fell together. Self edges and null ends are
    ignored. The rounds are logarithmic in the longest shortest path; each ends in a checkpoint.
    """
    rest = cut(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    )
    labels = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("p")))
        while True:
            over = up.select(F.col("n").alias("p"), F.col("p").alias("q"))
            nxt = cut(up.join(over, "p", "left").select("n", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")))
            up = nxt.select("n", "p")
            if nxt.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            to = up.select(F.col("n").alias("component"), F.col("p").alias("q"))
            labels = cut(labels.join(to, "component", "left").select("node", F.coalesce("q", "component").alias("component")))
        left = up.select(F.col("n").alias("a"), F.col("p").alias("pa"))
        right = up.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        rest = cut(
            rest.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    if labels is None:
        kind = edges.schema[a].dataType
        return edges.sparkSession.createDataFrame([], "node long, component long").select(F.col("node").cast(kind), F.col("component").cast(kind))
    return labels
