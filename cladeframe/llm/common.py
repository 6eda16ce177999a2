"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.stage import scratch, shared_dir, staged

__all__ = ["by_ids", "freed", "fresh", "global_index", "need", "release", "scratch", "shared_dir", "shuffle_partitions", "staged", "table"]

NO_COLUMNS = "table lacks the columns "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(NO_COLUMNS + ", ".join(missing))


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


Batches = Iterator[pa.RecordBatch]


def freed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow; the worker, which Spark keeps for later tasks, gives back what a task used when it ends."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column: columns of ours never replace the caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, keys: list[Column], name: str, tag: str) -> DataFrame:
    """Number the rows of df from 0 in the order of keys, without gathering them in one task.

    The rows are range-partitioned and sorted by keys, staged, counted by partition (one row per
    partition), and shifted by the rows of all partitions before their own.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    fixed = staged(ordered.withColumn("_mid", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_mid", 33)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition: their number is a setting, not a property of the data.
    offsets = counts.selectExpr("_part AS _p", "sum(_n) OVER (ORDER BY _part) - _n AS _before")
    joined = fixed.withColumn("_part", part).join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    row = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("_before") + row).drop("_mid", "_part", "_p", "_before")


#: Ids that are broadcast at most: 8 MB of longs.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """docs semi- or anti-joined with the one column of ids (staged). A counted set of at most so many
    ids is broadcast; a larger one is joined by a shuffle of both sides."""
    name = ids.columns[0]
    few = ids.count() <= most
    return docs.join(F.broadcast(ids) if few else ids, docs[key] == ids[name], how)
