"""Building families with external tools: align, tree, prune, realign; placement and rescue of what is left; branch tests.

Tools run once per group on the executor that holds it (tools.per_group). A group whose tool fails goes back to the pool
with the reason; nothing is lost. Any tool can be replaced by a table of what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.config import Settings
from cladeframe.functions.exprs import lrt_pvalue
from cladeframe.operators import prune as P
from cladeframe.operators import selection as L
from cladeframe.operators import trees as T
from cladeframe.operators.stats import benjamini_hochberg
from cladeframe.operators.topk import best_hit
from cladeframe.sources.newick import tree_nodes
from cladeframe.sources.tools import Tool, per_group
from cladeframe.stage import staged


def write_sequences(pdf: pd.DataFrame, path: Path) -> None:
    path.write_text("".join(f">{i}\n{s}\n" for i, s in zip(pdf["gene"], pdf["seq"], strict=True)))


def read_sequences(path: Path) -> pd.DataFrame:
    rows = [r.split("\n", 1) for r in path.read_text().split(">") if r.strip()]
    return pd.DataFrame([(head.split()[0], "".join(body.split())) for head, body in rows], columns=["gene", "aligned"])


def aligned(members: DataFrame, tool: Tool) -> DataFrame:
    """group, gene, aligned, error over members (group, gene, seq); a group whose run failed has one row with its error."""
    return per_group(members.select("group", "gene", "seq"), ["group"], tool, write_sequences, read_sequences, "group string, gene string, aligned string, error string")


def built_trees(alignments: DataFrame, tool: Tool) -> DataFrame:
    """group, newick, error over alignments (group, gene, aligned)."""
    rows = alignments.select("group", "gene", F.col("aligned").alias("seq"))
    return per_group(rows, ["group"], tool, write_sequences, lambda p: pd.DataFrame([{"newick": p.read_text().strip()}]), "group string, newick string, error string")


def codon_alignments(alignments: DataFrame, cds: DataFrame) -> DataFrame:
    """alignments (group, gene, aligned) with codons: null where a gene has no coding sequence or too short a one."""
    return alignments.join(cds.select("gene", F.col("seq").alias("_cds")), "gene", "left").withColumn("codons", L.back_translate(F.col("aligned"), F.col("_cds"))).drop("_cds")


def realigned(members: DataFrame, proteins: DataFrame, cds: DataFrame, tool: Tool) -> DataFrame:
    """group, gene, codons of groups whose every member has a protein and a coding sequence and whose run worked; others are absent."""
    known = members.select("group", "gene").join(proteins.select("gene", "seq"), "gene", "left").join(cds.select("gene", F.lit(True).alias("_cds")).distinct(), "gene", "left")
    whole = known.groupBy("group").agg(F.bool_and(F.col("seq").isNotNull() & F.col("_cds").isNotNull()).alias("ok")).where("ok").select("group")
    rows = staged(aligned(known.join(whole, "group", "left_semi"), tool), "realigned").where("error IS NULL")
    out = codon_alignments(rows, cds)
    bad = out.where("codons IS NULL").select("group").distinct()
    return out.join(bad, "group", "left_anti").select("group", "gene", "codons")


def tool_outliers(trees: DataFrame, tool: Tool | None) -> DataFrame:
    """family, gene that an outlier detector takes out of trees (family, newick). No tool, or a run that fails: none."""
    if tool is None or not tool.configured:
        return trees.sparkSession.createDataFrame([], "family string, gene string")
    write = lambda pdf, path: path.write_text(pdf["newick"].iloc[0] + "\n")
    read = lambda path: pd.DataFrame({"gene": path.read_text().split() if path.exists() else []}, dtype=object)
    found = per_group(trees.select("family", "newick"), ["family"], tool, write, read, "family string, gene string, error string")
    return found.where("error IS NULL AND gene IS NOT NULL").select("family", "gene").distinct()


def pruned_families(trees: DataFrame, species: DataFrame, expected: DataFrame, removed: DataFrame, settings: Settings | None = None) -> DataFrame:
    """family, gene, species, outlier over trees (family, newick) and species (gene, species).

    removed (family, gene) is what the detector took out; the distance ratio then judges the survivors, in the tree
    without the removed ones. Families of too few leaves or species, as they were built, are left alone by both.
    """
    s = settings or Settings()
    nodes = staged(tree_nodes(trees, "family", "newick"), "family-trees")
    leaves = nodes.where("is_leaf").select(F.col("tree_id").alias("family"), F.col("name").alias("gene")).join(species, "gene")
    size = leaves.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("species").alias("k")).where((F.col("n") >= s.prune_min_leaves) & (F.col("k") >= s.prune_min_species)).select("family")
    gone = removed.join(size, "family", "left_semi").withColumn("_gone", F.lit(True))
    marked = leaves.join(gone, ["family", "gene"], "left")
    left = marked.where("_gone IS NULL").drop("_gone")
    terminal = P.surviving_terminals(nodes, left.select(F.col("family").alias("tree_id"), "gene")).withColumnRenamed("tree_id", "family")
    distances = T.patristic(nodes).select(F.col("tree_id").alias("family"), "a", "b", F.col("distance").alias("d"))
    judged = P.pruned(left.join(terminal, ["family", "gene"]), distances, expected, s.prune_criterion, s.prune_absolute, s.prune_relative, s.prune_floor, 0, 0)
    far = judged.where("outlier").select("family", "gene").join(size, "family", "left_semi").withColumn("_far", F.lit(True))
    both = marked.join(far, ["family", "gene"], "left")
    return both.withColumn("outlier", F.col("_gone").isNotNull() | F.col("_far").isNotNull()).drop("_gone", "_far")


@dataclass(frozen=True)
class Chain:
    """The tools of a construction round: an aligner, a tree builder, an optional outlier detector."""

    align: Tool
    tree: Tool
    outliers: Tool | None = None


def orthogroups(members: DataFrame, species: DataFrame, expected: DataFrame, chain: Chain, settings: Settings | None = None) -> DataFrame:
    """group, gene, confirmed, error over members (group, gene, seq): align, tree, prune.

    A gene is confirmed if its group went through every step and it is no outlier; all genes of a group that failed are
    unconfirmed and carry the reason. Every member has one row.
    """
    rows = staged(aligned(members, chain.align), "aligned")
    good = rows.where("error IS NULL")
    trees = staged(built_trees(good, chain.tree), "trees")
    of = trees.where("error IS NULL").select(F.col("group").alias("family"), "newick")
    kept = pruned_families(of, species, expected, tool_outliers(of, chain.outliers), settings).where(~F.col("outlier")).select(F.col("family").alias("group"), "gene", F.lit(True).alias("_ok"))
    failed = rows.where("error IS NOT NULL").select("group", "error").unionByName(trees.where("error IS NOT NULL").select("group", "error")).groupBy("group").agg(F.first("error").alias("error"))
    out = members.select("group", "gene").distinct().join(kept, ["group", "gene"], "left").join(failed, "group", "left")
    return out.select("group", "gene", F.coalesce("_ok", F.lit(False)).alias("confirmed"), "error")


def placing(cluster: Callable[[DataFrame, int], DataFrame], proteins: DataFrame, species: DataFrame, expected: DataFrame, chain: Chain, settings: Settings | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """What Rounds.run asks for: cluster(pool, number) gives group, gene; the groups then go through the chain."""

    def place(pool: DataFrame, number: int) -> DataFrame:
        members = cluster(pool, number).select("group", "gene").join(proteins.select("gene", "seq"), "gene")
        return staged(orthogroups(members, species, expected, chain, settings), f"round-{number}").select("gene", "group", "confirmed")

    return place


def rescued(unplaced: DataFrame, hits: DataFrame, families: DataFrame, settings: Settings | None = None) -> DataFrame:
    """gene, family, evalue, bits: for each unplaced gene the family of its best profile hit within max_evalue.

    hits: gene, family, evalue, bits. Ties go to the larger bits, then to the first family by name. Families that aren't
    in families (gene, family) take nothing.
    """
    s = settings or Settings()
    ok = hits.where(F.col("evalue") < s.max_evalue).join(unplaced.select("gene").distinct(), "gene", "left_semi").join(families.select("family").distinct(), "family", "left_semi")
    return best_hit(ok, ["gene"], [F.col("evalue"), F.col("bits").desc(), F.col("family")]).select("gene", "family", "evalue", "bits")


def grown(families: DataFrame, found: DataFrame) -> DataFrame:
    """gene, family of the families that took genes in: what has to be aligned again."""
    return families.select("gene", "family").join(found.select("family").distinct(), "family", "left_semi").unionByName(found.select("gene", "family"), allowMissingColumns=False)


def adjudicated(genes: DataFrame, candidates: DataFrame, accepted: DataFrame, edges: DataFrame, settings: Settings | None = None) -> DataFrame:
    """gene, family: the candidate family that a gene's accepted placement says, else null.

    genes: gene, length. candidates: gene, family. accepted: gene, reference, edge_num, one row per gene. edges: reference,
    edge_num, family. Too short a gene, no accepted placement, an edge without family or a family that was no candidate: null.
    """
    s = settings or Settings()
    long = genes.where(F.col("length") >= s.min_query_length).select("gene")
    said = accepted.join(long, "gene", "left_semi").join(edges, ["reference", "edge_num"]).select("gene", "family").join(candidates.select("gene", "family").distinct(), ["gene", "family"], "left_semi")
    return genes.select("gene").join(said, "gene", "left")


def branch_tests(fits: DataFrame) -> DataFrame:
    """event, lnl_null, lnl_alt, p, q over fits (event, hypothesis: null or alt, lnl): the best run of each hypothesis.

    Events that lack a run of either have no row, as after a failed fit; q is over the tested ones.
    """
    best = fits.where("lnl IS NOT NULL").groupBy("event").agg(F.max(F.when(F.col("hypothesis") == "null", F.col("lnl"))).alias("lnl_null"), F.max(F.when(F.col("hypothesis") == "alt", F.col("lnl"))).alias("lnl_alt"))
    tested = best.where("lnl_null IS NOT NULL AND lnl_alt IS NOT NULL").withColumn("p", lrt_pvalue(F.col("lnl_alt"), F.col("lnl_null")))
    return benjamini_hochberg(tested, "p")


def low_confidence(structures: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Structures (gene, plddt) under the confidence bound, by name."""
    return structures.where(F.col("plddt") < (settings or Settings()).low_plddt).orderBy("gene")


def structure_problems(atoms: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """file, problem of predicted structures: no CA atom, a confidence outside 0 to 100, or another count of residues than expected (file, residues).

    atoms as from text.pdb_atoms; a sound file has no row. Files without any ATOM row are found only if expected names them.
    """
    by = atoms.groupBy("file").agg(F.count_if(F.col("atom") == "CA").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value").isNull()).alias("unread"))
    if expected is not None:
        by = expected.join(by, "file", "left")
    else:
        by = by.withColumn("residues", F.col("n"))
    problem = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no atoms")
        .when(F.col("unread") > 0, "unreadable confidence")
        .when((F.col("lo") < 0) | (F.col("hi") > 100), "confidence out of range")
        .when(F.col("n") != F.col("residues"), "residue count")
    )
    return by.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def refreshed(cache: DataFrame | None, fresh: DataFrame, key: str) -> DataFrame:
    """A cache of predictions with new rows: a key's new row replaces its old one. No cache yet: the new rows."""
    return fresh if cache is None else cache.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
