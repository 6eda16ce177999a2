"""Lineage cuts: a DataFrame written once as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset, as in tests on one machine."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="cladeframe-")
        sc.setCheckpointDir(where)
    return where


#: The files staged in each open scratch scope, the outermost first.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Spark's setting that removes a query's shuffle files when the query has ended, and not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes that go to a Python worker at once, and its value where they are whole texts: by rows alone
#: a batch would be all texts of a partition, which the executor and its worker would both hold.
BATCH_BYTES, TEXT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _write(df: DataFrame, path: str, texts: bool) -> None:
    """df written to path; nothing reads its shuffle files after that, so they go."""
    conf = df.sparkSession.conf
    wanted = {SHUFFLE_CLEANUP: "true"} | ({BATCH_BYTES: str(TEXT_BATCH)} if texts else {})
    before = {k: conf.get(k) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def staged(df: DataFrame, tag: str, lasting: bool = False, texts: bool = False) -> DataFrame:
    """df, computed once: later plans read its files, also after an executor is lost.

    The files go with the scratch scope they are staged in, lasting ones with the scope around it, all with the application.
    With texts, what Python workers get comes in batches of TEXT_BATCH bytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _write(df, path, texts)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    scopes = _scopes.get()[:-1] if lasting else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Files staged inside are removed at the end, so a result that outlives the scope must be staged as lasting."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            remove(spark, path)


#: Rows that one task of a spread table gets, on average.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys over tasks in proportion to rows, so that a task's share doesn't grow with the table. Grouping and joins by these keys (or more) follow without another shuffle."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks, *keys)


def in_ranges(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """df, staged, sorted by keys over as many ranges as there are shuffle partitions; _range numbers them in order.

    Running totals then need a window in each range and one over a row per range, instead of one task for all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id())
    return staged(ordered, tag)


def running_sums(df: DataFrame, keys: list[str], values: dict[str, str], tag: str) -> DataFrame:
    """df with a column per name in values: the sum of the named column over all rows up to this one in the order of keys, which must tell all rows apart."""
    fixed = in_ranges(df, keys, tag)
    sums = fixed.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    # A row per range.
    before = sums.selectExpr("_range", *[f"sum(_sum_{n}) OVER (ORDER BY _range) - _sum_{n} AS _before_{n}" for n in values])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = fixed.join(F.broadcast(before), "_range").withColumns({n: F.col(f"_before_{n}") + F.sum(v).over(inside) for n, v in values.items()})
    return out.drop("_range", *[f"_before_{n}" for n in values])


def running_sum(df: DataFrame, keys: list[str], value: str, name: str, tag: str) -> DataFrame:
    """df with the sum of value over all rows up to this one in the order of keys, which must tell all rows apart."""
    return running_sums(df, keys, {name: value}, tag)


def running_last(df: DataFrame, keys: list[str], value: Column, name: str, tag: str) -> DataFrame:
    """df with the last value that isn't null among all rows up to this one in the order of keys, which must tell all rows apart."""
    fixed = in_ranges(df.withColumn("_value", value), keys, tag)
    lasts = fixed.groupBy("_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*keys))).alias("_last"))
    before = lasts.selectExpr("_range", "last(_last, true) OVER (ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before")
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last("_value", ignorenulls=True).over(inside)
    return fixed.join(F.broadcast(before), "_range").withColumn(name, F.coalesce(own, F.col("_before"))).drop("_range", "_before", "_value")
