"""Families of genes grown from sure members, round by round, over the profiles that genes share.

    python -m jobs.grow_families --hits TABLE --out FOLDER [--config FILE]

Genes with a sure hit are the seeds of their families. In each round the genes that share a profile with those placed in
the last one join them, until a round places none; what no family reaches stays open. out/rounds keeps every finished round:
a run that stopped goes on there, a run over the same table finds all rounds done, one over another table starts over.
out/members, partitioned by status, has every gene of the table.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.rounds import Growth
from cladeframe.operators.sets import orphans
from cladeframe.session import session
from jobs.common import logger, settings, show_log

log = logger("grow_families")


@dataclass(frozen=True)
class Growing:
    """Column names of the hits, the scores from which a hit links and seeds, and a bound of rounds (null: none)."""

    gene: str = "gene"
    profile: str = "profile"
    family: str = "family"
    score: str = "bits"
    min_score: float = 50.0
    seed_score: str = "bits"
    min_seed_score: float = 500.0
    max_rounds: int | None = None
    spread: int = 8


MEMBERS = "gene string, family string, round int, status string"


def run(spark: SparkSession, hits: str, out: str, c: Growing) -> DataFrame:
    """Grow families over the table of hits; returns gene, family, round, status: placed, open (linked to others) or unlinked, a row per gene.

    Rows without a gene are left out and counted in the log. Hits without a profile link nothing. RuntimeError if a gene
    would be lost or placed twice.
    """
    table = spark.read.parquet(hits)
    rows = table.select(F.col(c.gene).cast("string").alias("gene"), F.col(c.profile).cast("string").alias("profile"), F.col(c.family).cast("string").alias("family"), (F.col(c.score) >= c.min_score).alias("links"), (F.col(c.seed_score) >= c.min_seed_score).alias("sure"))
    n, bad = table.agg(F.count("*"), F.count_if(F.col(c.gene).isNull())).first()
    log.info("read %d hits from %s, %d without a gene", n, hits, bad)
    growth = Growth(spark, f"{out}/rounds")
    linking = rows.where("links").select("gene", "profile")
    mark = growth.run(linking, rows.where("sure").select("gene", "family"), c.max_rounds)
    members = growth.placed(mark["round"])
    genes = rows.where("gene IS NOT NULL").select("gene").distinct()
    linked = linking.where("profile IS NOT NULL").select("gene").distinct().withColumn("_linked", F.lit(True))
    left = orphans(genes, members, "gene").join(linked, "gene", "left")
    status = F.when(F.col("_linked"), "open").otherwise("unlinked")
    none = left.select("gene", F.lit(None).cast("string").alias("family"), F.lit(None).cast("int").alias("round"), status.alias("status"))
    every = members.select("gene", "family", "round", F.lit("placed").alias("status")).unionByName(none)
    dealt = every.repartition("status", F.pmod(F.xxhash64("gene"), F.lit(c.spread)))
    dealt.write.mode("overwrite").partitionBy("status").parquet(f"{out}/members")
    written = spark.read.schema(MEMBERS).parquet(f"{out}/members")
    n_rows, n_genes, n_placed = written.agg(F.count("*"), F.countDistinct("gene"), F.count("family")).first()
    log.info("wrote %d genes to %s/members, %d in families after %d rounds", n_rows, out, n_placed, mark["round"])
    if not n_rows == n_genes == genes.count():
        raise RuntimeError(f"{n_rows} rows for {n_genes} genes: a gene was lost or placed twice")
    return written


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.grow_families", description=__doc__)
    for name in ("hits", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=None, help="JSON of settings; by default the one beside the job")
    a = p.parse_args(argv)
    show_log()
    spark = session("grow_families")
    try:
        run(spark, a.hits, a.out, settings(Growing, a.config, "grow_families.json"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
