"""Hits that arrive in files are placed batch by batch; what isn't placed waits in the pool for later hits.

The same margin rule as in batch decides; a batch is written once under its number, so a batch that is run again after a
failure replaces its own output and no gene is placed twice or lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeframe.functions.exprs import margin_required
from cladeframe.operators.topk import with_margin


def place_arriving(stream: DataFrame, folder: str, checkpoint: str, max_evalue: float = 1e-5, once: bool = True) -> StreamingQuery:
    """Start a query over a stream of hits (gene, family, bits, evalue) that writes folder/batch=N with gene, family, status.

    A gene that an earlier batch assigned keeps its family; its later hits are passed over.
    """

    def batch(hits: DataFrame, number: int) -> None:
        spark = hits.sparkSession
        done = assigned(spark, folder, number)
        fresh = hits if done is None else hits.join(done.select("gene"), "gene", "left_anti")
        out = with_margin(fresh, "gene", "family", "bits", F.col("evalue") <= max_evalue, margin_required(F.col("bits")))
        out.select("gene", "family", "status").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def assigned(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """All assignments so far (of batches before a number); None if there is no batch yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(s.isDirectory() and s.getPath().getName().startswith("batch=") for s in fs.listStatus(path)):
        return None
    df = spark.read.option("basePath", folder).parquet(folder)
    return (df if before is None else df.where(F.col("batch") < before)).where("status = 'assigned'").drop("batch")
