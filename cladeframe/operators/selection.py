"""Verdicts over selection evidence, gene model repair, and greedy choice of overlapping models."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.stage import in_ranges, running_sum, staged


def selection_verdict(evidence: DataFrame, alpha: float = 0.05, dominance: float = 0.5) -> DataFrame:
    """evidence with verdict, evidence_for and evidence_against; null evidence abstains.

    Columns: relax_k, relax_p, stem (array of branches under positive selection), terminal (the same for tips),
    expression_share, signal (text), retargeting (count), meme_in_region (count), branchsite_p, disorder_delta, disorder_p.
    """
    c = F.col
    nothing = c("relax_k").isNull() & (F.coalesce(F.size("stem"), F.lit(0)) == 0) & (F.coalesce(F.size("terminal"), F.lit(0)) == 0) & c("meme_in_region").isNull()
    yes = lambda x: F.coalesce(x, F.lit(False))
    relaxed = yes((c("relax_k") < 1) & (c("relax_p") <= alpha))
    stem = yes(F.size("stem") > 0)
    signal = yes(c("signal") != "")
    dominant = yes(c("expression_share") >= dominance)
    moved = yes(c("retargeting") > 0)
    branch = yes(c("branchsite_p") <= alpha)
    disordered = yes((c("disorder_p") <= alpha) & (c("disorder_delta") < 0))
    said = lambda cond, text: F.when(cond, F.lit(text))
    for_ = F.array_compact(
        F.array(
            said(relaxed, "relaxed selection"),
            F.when(stem, F.concat(F.lit("stem positive selection: "), F.array_join("stem", ", "))),
            said(dominant, "expression dominance"),
            F.when(signal, F.concat(F.lit("signal-region partition: "), c("signal"))),
            said(yes(c("meme_in_region") == 0) & signal, "no episodic selection inside the signal region"),
            said(branch & stem, "branch-site test significant"),
            said(disordered, "signal region disordered"),
            said(moved & ~nothing, "retargeting events on the family tree"),
        )
    )
    against = F.array_compact(
        F.array(
            F.when(yes(F.size("terminal") > 0), F.concat(F.lit("terminal positive selection only: "), F.array_join("terminal", ", "))),
            said(branch & ~stem, "branch-site test significant, not localized to the stem"),
        )
    )
    none = F.array().cast("array<string>")
    what = F.when(nothing, "insufficient evidence").when(stem | moved, "neofunctionalization").when(relaxed & (dominant | signal), "subfunctionalization").otherwise("conserved/inconclusive")
    return evidence.withColumns({"verdict": what, "evidence_for": F.when(nothing, none).otherwise(for_), "evidence_against": F.when(nothing, none).otherwise(against)})


def named_branches(branches: DataFrame, names: DataFrame) -> DataFrame:
    """branches with the real name of each short one (names: short, real); unknown ones keep theirs."""
    return branches.join(names.withColumnRenamed("short", "branch"), "branch", "left").withColumn("branch", F.coalesce("real", "branch")).drop("real")


def acceptance(identity: Column, protein: Column, min_identity: float = 0.95, min_length: int = 300) -> Column:
    """ok, or the first reason to refuse a gene model."""
    body = F.rtrim(protein, F.lit("*"))
    return F.when(identity < min_identity, "identity").when(F.contains(body, F.lit("*")), "internal stop").when(F.length(body) < min_length, "length").otherwise("ok")


def loci(models: DataFrame, contig: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """models with locus: the start of their island. A model more than gap after the end of all before it on its contig begins one.

    Models without a contig, start or end have no place and are left out.
    Contigs of any size: models lie in ranges over all contigs; what a range needs of those before it is a contig's largest end and
    last island, a row per contig and range.
    """
    keys = [contig, start, end]
    known = models.where(F.col(contig).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    fixed = in_ranges(known, keys, "loci")
    inside = Window.partitionBy("_range", contig).orderBy(start, end)
    earlier = Window.partitionBy(contig).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = fixed.groupBy(contig, "_range").agg(F.max(end).alias("_most")).withColumn("_reach", F.max("_most").over(earlier)).drop("_most")
    before = F.greatest("_reach", F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    new = before.isNull() | (F.col(start) > before + gap)
    flagged = staged(fixed.join(ends, [contig, "_range"]).withColumn("_new", F.when(new, F.col(start))).drop("_reach"), "loci-starts")
    # Starts rise, so the last island is the one with the largest start.
    lasts = flagged.groupBy(contig, "_range").agg(F.max("_new").alias("_last")).withColumn("_open", F.max("_last").over(earlier)).drop("_last")
    own = F.max("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.join(lasts, [contig, "_range"]).withColumn("locus", F.coalesce(own, F.col("_open"))).select(*models.columns, "locus")


def best_per_locus(models: DataFrame, contig: str, start: str, end: str, score: str, gap: int = 0) -> DataFrame:
    """Greedy choice along each contig: by falling score (ties by start, end), a model stays unless it overlaps a kept one.

    The choice in an island of overlapping models doesn't depend on others, so an island is a task's unit and a contig is not. Spark
    sorts the models into the order of choice; a task then passes over its islands one model after another and
    holds the kept ones of one island, which don't overlap: a model need only be compared with its two neighbours among them.
    """
    columns = models.columns
    ordered = loci(models, contig, start, end, gap).repartition(contig, "locus").sortWithinPartitions(contig, "locus", F.col(score).desc(), start, end)
    passed = ordered.select(*columns, F.struct(F.col(contig).cast("string"), F.col("locus").cast("long")).alias("_at"), F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, starts, ends = None, [], []
        for batch in batches:
            keep = []
            for at, a, b in zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), batch.column(len(columns) + 2).to_pylist(), strict=True):
                if at != island:
                    island, starts, ends = at, [], []
                i = bisect_right(starts, b)  # kept models from i on start behind this one
                ok = i == 0 or ends[i - 1] < a
                if ok:
                    starts.insert(i, a)
                    ends.insert(i, b)
                keep.append(ok)
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    return passed.mapInArrow(run, models.schema)


def back_translate(aligned: Column, cds: Column) -> Column:
    """A codon alignment: each residue of an aligned protein as its codon, each gap as three; null if the coding sequence is too short."""
    # Codons in order: a residue's codon is that of the residues before it, so no running state is needed.
    codons = F.filter(F.regexp_extract_all(cds, F.lit("(?s).{1,3}"), F.lit(0)), lambda c: F.length(c) == 3)
    runs = F.regexp_extract_all(aligned, F.lit("-+|[^-]+"), F.lit(0))
    gaps = F.transform(runs, lambda r: F.when(r.startswith("-"), F.repeat(F.lit("-"), 3 * F.length(r))))
    placed = F.aggregate(
        F.sequence(F.lit(1), F.size(runs)),
        F.struct(F.lit(0).alias("k"), F.lit("").alias("out")),
        lambda acc, i: F.struct(
            (acc["k"] + F.when(F.element_at(gaps, i).isNull(), F.length(F.element_at(runs, i))).otherwise(0)).alias("k"),
            F.concat(acc["out"], F.coalesce(F.element_at(gaps, i), F.array_join(F.slice(codons, acc["k"] + 1, F.length(F.element_at(runs, i))), ""))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    whole = F.when(F.length(aligned) > 0, placed).otherwise("")
    return F.when(F.length(cds) >= 3 * F.length(F.replace(aligned, F.lit("-"), F.lit(""))), whole)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose output doesn't exist yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def by_length(sequences: DataFrame, length: str, most: int = 1100) -> tuple[DataFrame, DataFrame]:
    """Sequences short enough to fold, and the others."""
    return sequences.where(F.col(length) <= most), sequences.where(F.col(length) > most)


def stale_profiles(members: DataFrame, built: DataFrame, family: str, gene: str) -> DataFrame:
    """Families whose profile is missing, empty or built of other members: family, digest. built: family, digest, size."""
    from cladeframe.functions.exprs import member_digest

    now = members.groupBy(family).agg(member_digest(F.collect_set(gene)).alias("digest"))
    return now.join(built.where("size > 0").select(family, "digest"), [family, "digest"], "left_anti")


def cost_batches(items: DataFrame, length: str, n: int, keys: list[str]) -> DataFrame:
    """items with cost (expected milliseconds) and batch 0..n-1: cuts of near equal cost through the order of keys, which tell items apart.

    A running sum over ranges places the middle of each item; no batch exceeds the mean cost by more than the dearest item.
    """
    from cladeframe.functions.exprs import fold_seconds

    priced = items.withColumn("cost", F.greatest(F.lit(1), F.round(fold_seconds(F.col(length)) * 1000)).cast("long"))
    summed = running_sum(priced, keys, "cost", "_upto", "batches")
    total = priced.agg(F.sum("cost").alias("_total"))  # one row
    middle = 2 * F.col("_upto") - F.col("cost")
    batch = F.least(F.floor(middle / (2 * F.col("_total")) * n), F.lit(n - 1)).cast("int")
    return summed.crossJoin(F.broadcast(total)).withColumn("batch", batch).drop("_upto", "_total")


def batches_of(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Re-cut an iterator of frames into frames of n rows."""
    held: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        held.append(f)
        size += len(f)
        while size >= n:
            whole = pd.concat(held)
            yield whole.iloc[:n]
            held, size = [whole.iloc[n:]], len(whole) - n
    if size:
        yield pd.concat(held)
