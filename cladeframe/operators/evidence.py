"""Pseudogene evidence: independent scanners, one merge by gene, a weighted score and its class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.sets import orphans
from cladeframe.operators.stats import group_medians

#: What each line of evidence adds to the score, added in this order.
WEIGHTS = (("internal_stops", 0.40), ("length_ratio", 0.35), ("truncated", 0.30), ("orphan", 0.25), ("zscore", 0.25), ("distance_ratio", 0.20))
CLASSES = ((0.50, "pseudogene_high"), (0.25, "pseudogene_medium"))


def inner_count(seq: Column, mark: str) -> Column:
    """How often mark stands in a sequence, not counting those at its end."""
    body = F.rtrim(seq, F.lit(mark))
    return (F.length(body) - F.length(F.replace(body, F.lit(mark), F.lit("")))).cast("long")


def internal_stops(genes: DataFrame, gene: str, seq: str, mark: str = "*") -> DataFrame:
    return genes.select(gene, inner_count(F.col(seq), mark).alias("internal_stops")).where("internal_stops > 0")


def length_discrepancies(proteins: DataFrame, cds: DataFrame, gene: str, protein_length: str, cds_length: str, per: float = 3.0, tolerance: float = 0.1) -> DataFrame:
    """Genes whose coding length is not per times their protein length, by more than the tolerance."""
    ratio = F.col(cds_length) / (F.lit(per) * F.col(protein_length))
    met = proteins.where(F.col(protein_length) > 0).join(cds, gene).withColumn("length_ratio", ratio)
    note = F.when(F.col("length_ratio") < 1, "cds_short").otherwise("cds_long")
    return met.where(F.abs(F.col("length_ratio") - 1) > tolerance).select(gene, "length_ratio", F.array(note).alias("notes"))


def truncated(genes: DataFrame, gene: str, family: str, length: str, threshold: float = 0.5) -> DataFrame:
    """Genes shorter than a share of their family's exact median length."""
    medians = group_medians(genes, [family], length, "_median")
    return genes.join(medians, family).where(F.col(length) < F.lit(threshold) * F.col("_median")).select(gene, F.lit(True).alias("truncated"))


def orphan_genes(genes: DataFrame, placed: DataFrame, gene: str) -> DataFrame:
    return orphans(genes, placed, gene).select(gene, F.lit(True).alias("orphan"))


def composition(cds: Column) -> list[Column]:
    """GC share, and GC share at third positions, of a coding sequence after gaps and N are taken out; null below nine bases."""
    clean = F.regexp_replace(F.upper(cds), "[-N]", "")
    third = F.regexp_replace(clean, "(?s)..(.)|.{1,2}$", "$1")
    gc = lambda s: F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s)
    return [F.when(F.length(clean) >= 9, gc(clean)).alias("gc"), F.when(F.length(clean) >= 9, gc(third)).alias("gc3")]


def composition_outliers(genes: DataFrame, gene: str, species: str, share: str, threshold: float = 3.0, min_n: int = 20) -> DataFrame:
    """Genes whose share is more than so many sample deviations from their species' mean, in species of enough genes."""
    stats = genes.where(F.col(share).isNotNull()).groupBy(species).agg(F.avg(share).alias("_mean"), F.stddev_samp(share).alias("_sd"), F.count("*").alias("_n"))
    z = (F.col(share) - F.col("_mean")) / F.col("_sd")
    met = genes.join(stats.where((F.col("_n") >= min_n) & (F.col("_sd") > 0)), species).withColumn("zscore", z)
    return met.where(F.abs("zscore") > threshold).select(gene, "zscore")


def distance_outliers(leaves: DataFrame, tree: str, gene: str, root_to_tip: str, ratio: float = 3.0, min_leaves: int = 3) -> DataFrame:
    """Leaves further from the root than ratio times their tree's median."""
    stats = group_medians(leaves, [tree], root_to_tip, "_median").join(leaves.groupBy(tree).agg(F.count("*").alias("_n")), tree)
    met = leaves.join(stats.where((F.col("_n") >= min_leaves) & (F.col("_median") > 0)), tree)
    far = met.withColumn("distance_ratio", F.col(root_to_tip) / F.col("_median")).where(F.col("distance_ratio") > ratio)
    return far.groupBy(gene).agg(F.max("distance_ratio").alias("distance_ratio"))


COLUMNS = {"internal_stops": "long", "length_ratio": "double", "truncated": "boolean", "orphan": "boolean", "zscore": "double", "distance_ratio": "double", "notes": "array<string>"}


def merge(scans: list[DataFrame], gene: str) -> DataFrame:
    """One row per gene from any scans in order: most stops, any flag, largest distance, the last scan's other numbers, all notes once."""
    parts = []
    for i, scan in enumerate(scans):
        have = [F.col(c).cast(t).alias(c) if c in scan.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()]
        parts.append(scan.select(F.col(gene), F.lit(i).alias("_scan"), *have))
    union = reduce(DataFrame.unionByName, parts)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_scan"))).alias(c)
    notes = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_scan", F.coalesce("notes", F.array().cast("array<string>")).alias("n")))), lambda x: x["n"])))
    return union.groupBy(gene).agg(
        F.coalesce(F.max("internal_stops"), F.lit(0)).alias("internal_stops"),
        last("length_ratio"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
        F.coalesce(F.bool_or("orphan"), F.lit(False)).alias("orphan"),
        last("zscore"),
        F.max("distance_ratio").alias("distance_ratio"),
        notes.alias("notes"),
    )


def fired(c: str) -> Column:
    tests = {
        "internal_stops": F.col(c) > 0,
        "length_ratio": F.abs(F.col(c) - 1) > 0.1,
        "truncated": F.col(c),
        "orphan": F.col(c),
        "zscore": F.abs(c) > 3.0,
        "distance_ratio": F.col(c) > 3.0,
    }
    return F.coalesce(tests[c], F.lit(False))


def score() -> Column:
    total = F.lit(0.0)
    for c, w in WEIGHTS:
        total = total + F.when(fired(c), F.lit(w)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def classified(s: Column) -> Column:
    high, medium = CLASSES
    return F.when(s >= high[0], high[1]).when(s >= medium[0], medium[1]).when(s > 0, "pseudogene_low").otherwise("functional")


def summary() -> Column:
    """The evidence that fired, and the notes, joined by semicolons; none without any."""
    said = F.array_compact(
        F.array(
            F.when(fired("internal_stops"), F.concat(F.lit("internal_stops="), F.col("internal_stops").cast("string"))),
            F.when(fired("length_ratio"), F.format_string("length_ratio=%.3f", F.col("length_ratio"))),
            F.when(fired("truncated"), F.lit("truncated")),
            F.when(fired("orphan"), F.lit("orphan")),
            F.when(fired("distance_ratio"), F.format_string("dist_ratio=%.2f", F.col("distance_ratio"))),
            F.when(fired("zscore"), F.format_string("gc3_zscore=%.2f", F.col("zscore"))),
        )
    )
    return F.coalesce(F.nullif(F.array_join(F.concat(said, F.col("notes")), ";"), F.lit("")), F.lit("none"))


def with_score(merged: DataFrame) -> DataFrame:
    return merged.withColumn("score", score()).withColumn("class", classified(F.col("score"))).withColumn("summary", summary())


def is_candidate(c: Column) -> Column:
    return F.coalesce(c != "functional", F.lit(False))


def family_report(members: DataFrame, evidence: DataFrame, gene: str, family: str, species: str) -> DataFrame:
    """By family with any candidate: members, candidates, their share and mean score, and per species x/y."""
    met = members.join(evidence.select(gene, "score", "class"), gene, "left").withColumn("_c", is_candidate(F.col("class")).cast("int"))
    by = met.groupBy(family, species).agg(F.count("*").alias("_n"), F.sum("_c").alias("_p"), F.sum(F.when(F.col("_c") == 1, F.col("score"))).alias("_s"))
    listed = F.sort_array(F.collect_list(F.struct(F.col(species).alias("s"), F.col("_p").alias("p"), F.col("_n").alias("n"))))
    out = by.groupBy(family).agg(F.sum("_n").alias("n_total"), F.sum("_p").alias("n_pseudo"), (F.sum("_s") / F.sum("_p")).alias("mean_score"), F.count_if(F.col("_p") > 0).alias("n_species"), F.filter(listed, lambda x: x["p"] > 0).alias("_l"))
    out = out.where("n_pseudo > 0").withColumn("fraction", F.col("n_pseudo") / F.col("n_total"))
    text = F.array_join(F.transform("_l", lambda x: F.concat(x["s"], F.lit(":"), x["p"].cast("string"), F.lit("/"), x["n"].cast("string"))), ",")
    return out.select(family, "n_total", "n_pseudo", "fraction", "mean_score", text.alias("by_species"), "n_species")


def species_report(genes: DataFrame, placed: DataFrame, evidence: DataFrame, gene: str, species: str) -> DataFrame:
    """By species: genes, placed, orphans, candidates of each class, their rate and mean score."""
    flag = placed.select(gene).distinct().withColumn("_placed", F.lit(1))
    met = genes.join(flag, gene, "left").join(evidence.select(gene, "score", "class"), gene, "left")
    cand = is_candidate(F.col("class"))
    n = met.groupBy(species).agg(
        F.count("*").alias("n_total"),
        F.count("_placed").alias("n_placed"),
        F.count_if(F.col("_placed").isNull()).alias("n_orphan"),
        F.count_if(F.col("class") == "pseudogene_high").alias("n_high"),
        F.count_if(F.col("class") == "pseudogene_medium").alias("n_medium"),
        F.count_if(F.col("class") == "pseudogene_low").alias("n_low"),
        F.count_if(cand).alias("n_pseudo"),
        F.coalesce(F.avg(F.when(cand, F.col("score"))), F.lit(0.0)).alias("mean_score"),
    )
    return n.withColumn("rate", F.col("n_pseudo") / F.col("n_total"))


def location_report(genes: DataFrame, evidence: DataFrame, gene: str, location: str) -> DataFrame:
    """By chromosome (or host): genes, candidates, rate, high ones."""
    met = genes.join(evidence.select(gene, "class"), gene, "left")
    n = met.groupBy(location).agg(F.count("*").alias("n_total"), F.count_if(is_candidate(F.col("class"))).alias("n_pseudo"), F.count_if(F.col("class") == "pseudogene_high").alias("n_high"))
    return n.withColumn("rate", F.col("n_pseudo") / F.col("n_total"))


def counts(evidence: DataFrame, species: str) -> DataFrame:
    """level, name, n: candidates by class, by line of evidence and by species, from one pass of grouping sets."""
    kinds = [F.struct(F.lit("evidence").alias("level"), F.when(fired(c), F.lit(c)).alias("name")) for c, _ in WEIGHTS]
    every = F.array(F.struct(F.lit("class").alias("level"), F.col("class").alias("name")), F.struct(F.lit("species").alias("level"), F.col(species).alias("name")), *kinds)
    rows = evidence.where(is_candidate(F.col("class"))).select(F.explode(every).alias("x")).where("x.name IS NOT NULL")
    return rows.groupBy("x.level", "x.name").agg(F.count("*").alias("n"))


def bed(evidence: DataFrame, gene: str, species: str) -> DataFrame:
    """BED9 rows. Ids such as ..chr03g00120 give a place by number, 10 kb a gene; others go to <species>_unknown 0-1000."""
    pattern = r"(?i)(chr\w*?\d+|scaffold_?\d+|contig_?\d+)[gG](\d+)"
    chrom = F.regexp_extract(gene, pattern, 1)
    number = F.regexp_extract(gene, pattern, 2)
    at = F.when(chrom != "", number.try_cast("bigint") * 10000)
    colour = F.when(F.col("class") == "pseudogene_high", "255,0,0").when(F.col("class") == "pseudogene_medium", "255,165,0").otherwise("255,255,0")
    return evidence.where(is_candidate(F.col("class"))).select(
        F.when(at.isNotNull(), chrom).otherwise(F.concat(F.col(species), F.lit("_unknown"))).alias("chrom"),
        F.coalesce(at, F.lit(0)).alias("start"),
        F.coalesce(at + 1000, F.lit(1000)).alias("end"),
        F.col(gene).alias("name"),
        F.floor(F.col("score") * 1000).cast("long").alias("score"),
        F.lit(".").alias("strand"),
        F.coalesce(at, F.lit(0)).alias("thick_start"),
        F.coalesce(at + 1000, F.lit(1000)).alias("thick_end"),
        colour.alias("rgb"),
    )


def ranked(evidence: DataFrame, gene: str) -> DataFrame:
    """In report order: by class, then gene."""
    order = F.array_position(F.array(*map(F.lit, ("pseudogene_high", "pseudogene_medium", "pseudogene_low", "functional"))), F.col("class"))
    return evidence.orderBy(order, gene)

