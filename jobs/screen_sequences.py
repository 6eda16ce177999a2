"""Incremental screening: evidence that sequences are pseudogenes or copies, kept current while proteomes arrive as files.

    python -m jobs.screen_sequences --source TABLES --out FOLDER --checkpoint FOLDER [--config FILE]

A file stream takes the files that no earlier run took. Their sequences become a few numbers each in out/screened, by batch
and bucket of families; then the evidence of the families in touched buckets alone is found again and replaces
these buckets in out/report. out/mark holds the last batch that the report contains.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import evidence as E
from cladeframe.session import session
from cladeframe.stage import scratch, staged
from jobs.common import if_there, logger, settings, show_log

log = logger("screen_sequences")


@dataclass(frozen=True)
class Screening:
    """Column names of the source, the marks that the screens look for, their thresholds, and sizes of the output."""

    id: str = "gene"
    sequence: str = "seq"
    species: str = "species"
    family: str = "family"
    stop: str = "*"
    composition: str = "GC"
    truncation: float = 0.5
    zscore: float = 3.0
    zscore_min_n: int = 20
    buckets: int = 32
    spread: int = 4
    max_files_per_batch: int = 1000


NARROW = "gene string, species string, family string, length int, internal_stops long, share double, digest string"
SCREENED = f"{NARROW}, batch long, bucket int"


def narrow(rows: DataFrame, c: Screening) -> DataFrame:
    """What the screens need of each sequence; the sequence itself is read once and not kept.

    A null sequence is empty, a null species or family 'unknown'. gene is species_id.
    """
    seq = F.coalesce(F.col(c.sequence).cast("string"), F.lit(""))
    species, family = (F.coalesce(F.nullif(F.col(x).cast("string"), F.lit("")), F.lit("unknown")) for x in (c.species, c.family))
    share = F.length(F.regexp_replace(seq, f"[^{c.composition}]", "")).cast("double") / F.length(seq)
    return rows.select(
        F.concat_ws("_", species, F.col(c.id).cast("string")).alias("gene"),
        species.alias("species"),
        family.alias("family"),
        F.length(seq).alias("length"),
        E.inner_count(seq, c.stop).alias("internal_stops"),
        F.when(F.length(seq) > 0, share).alias("share"),
        F.sha2(seq, 256).alias("digest"),
        F.pmod(F.xxhash64(family), F.lit(c.buckets)).cast("int").alias("bucket"),
    )


def take_new(spark: SparkSession, source: str, out: str, checkpoint: str, c: Screening) -> None:
    """Write the numbers of all files that the checkpoint hasn't seen. A batch that runs again replaces what it wrote.

    Rows without an id can't be named in a report: they go to out/refused as they came.
    """

    def batch(rows: DataFrame, number: int) -> None:
        n, bad = rows.agg(F.count("*"), F.count_if(F.col(c.id).isNull())).first()  # of the files, the ids alone
        if bad:
            rows.where(F.col(c.id).isNull()).write.mode("overwrite").parquet(f"{out}/refused/batch={number}")
        narrow(rows.where(F.col(c.id).isNotNull()), c).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/screened/batch={number}")
        log.info("batch %d: read %d sequences from %s, %d without an id", number, n, source, bad)

    # The files' own schema: the stream needs it before it starts.
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c.max_files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def evidence(genes: DataFrame, c: Screening) -> DataFrame:
    """A row per gene of whole families: the screens' findings, score and class; copy_of is the first gene of the family with its sequence.

    A gene that came again counts once, as it last came. Empty sequences are no copies.
    """
    last = F.max_by(F.struct("species", "length", "internal_stops", "share", "digest", "bucket"), F.struct("batch", "digest", "length"))
    one = genes.groupBy("family", "gene").agg(last.alias("x")).select("family", "gene", "x.*")
    one = staged(one.withColumn("key", F.struct("family", "gene")), "screen-genes")
    scans = [
        one.where("internal_stops > 0").select("key", "internal_stops"),
        E.truncated(one, "key", "family", "length", c.truncation),
        E.composition_outliers(one, "key", "family", "share", c.zscore, c.zscore_min_n),
    ]
    scored = E.with_score(E.merge(scans, "key")).select("key", "truncated", "zscore", "score", "class")
    copies = one.where("length > 0").groupBy("family", "digest").agg(F.min("gene").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = one.join(scored, "key", "left").join(copies, ["family", "digest"], "left")
    return met.select(
        "gene",
        "species",
        "family",
        "length",
        "internal_stops",
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
        "zscore",
        F.when(F.col("gene") != F.col("first"), F.col("first")).alias("copy_of"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("class", F.lit("functional")).alias("class"),
        "bucket",
    )


def report(spark: SparkSession, out: str, c: Screening) -> None:
    """Find the evidence of buckets with new batches again and replace them; the mark moves last, so a run that stopped does them again."""
    screened = if_there(spark, f"{out}/screened", SCREENED)
    if screened is None:
        log.info("nothing was read yet")
        return
    mark = if_there(spark, f"{out}/mark", "batch long")
    done = -1 if mark is None else mark.agg(F.max("batch")).first()[0]
    # At most c.buckets numbers.
    fresh = screened.where(F.col("batch") > done).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
    if not fresh:
        log.info("no new batch since %d", done)
        return
    with scratch(spark):
        touched = screened.where(F.col("bucket").isin([r.bucket for r in fresh]))
        found = staged(evidence(touched, c), "screen-report")
        # A large bucket is written by several tasks.
        dealt = found.repartition("bucket", F.pmod(F.xxhash64("gene"), F.lit(c.spread)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/report")
        log.info("wrote %d genes of %d of %d buckets to %s/report", found.count(), len(fresh), c.buckets, out)
    last = max(r.batch for r in fresh)
    spark.createDataFrame([(last,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{out}/mark")


REPORT = "gene string, species string, family string, length int, internal_stops long, truncated boolean, zscore double, copy_of string, score double, class string, bucket int"


def run(spark: SparkSession, source: str, out: str, checkpoint: str, c: Screening) -> DataFrame | None:
    """Take what is new in source and bring the report up to it; returns the whole report, None if there is none yet.

    source: a folder of Parquet files, or a pattern that names files or folders (a stream takes no single file by its name).
    """
    take_new(spark, source, out, checkpoint, c)
    report(spark, out, c)
    return if_there(spark, f"{out}/report", REPORT)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.screen_sequences", description=__doc__)
    for name in ("source", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=None, help="JSON of settings; by default the one beside the job")
    a = p.parse_args(argv)
    show_log()
    spark = session("screen_sequences")
    try:
        run(spark, a.source, a.out, a.checkpoint, settings(Screening, a.config, "screen_sequences.json"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
