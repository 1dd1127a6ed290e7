"""Tables written on the way to a result, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fresh(spark: SparkSession, name: str = "table") -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, under a temporary folder, but only if all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}/{name}"


def numbered(df: DataFrame, order: list[Column], number: str = "_n", size: Column | None = None) -> DataFrame:
    """df with each row's place in that order, from 0; with size: the sum of size over the rows before it.

    The sorted rows are written once. A row's place is its place in its file and the counts of the files before; files are as many as the
    sort's partitions, so nothing but a few of their counts is ever in one task.
    """
    path = fresh(df.sparkSession, "sorted")
    rows = df.withColumn("_size", F.lit(1) if size is None else size)
    rows.orderBy(*order).write.parquet(path)
    back = df.sparkSession.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    totals = back.groupBy("_file").agg(F.sum("_size").alias("_all"))
    # A file's number is its partition's; past 99999 names are longer and don't sort by themselves.
    nth = F.regexp_extract("_file", r"part-(\d+)", 1).cast("bigint")
    before = totals.select("_file", (F.sum("_all").over(Window.orderBy(nth, "_file")) - F.col("_all")).alias("_before"))
    inside = F.col("_row") if size is None else F.sum("_size").over(Window.partitionBy("_file").orderBy("_row")) - F.col("_size")
    return back.withColumn("_inside", inside).join(before, "_file").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + F.col("_inside")).cast("bigint").alias(number))


def placed(df: DataFrame, key: list[str], order: list[Column], place: str) -> DataFrame:
    """df with each row's place among the rows of its key (no null), from 0: numbered() less the key's first number, so a key of many rows spreads over tasks."""
    path = fresh(df.sparkSession, "placed")
    numbered(df, [*(F.col(k) for k in key), *order], "_p").write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    return rows.join(rows.groupBy(*key).agg(F.min("_p").alias("_q")), key).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_p") - F.col("_q")).alias(place))
