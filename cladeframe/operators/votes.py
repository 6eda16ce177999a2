"""Majorities: weighted names, consensus that refuses ties, reciprocal votes between families, purities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators.topk import best_hit
from cladeframe.stage import spread


def weighted_names(rows: DataFrame, group: str, description: str, source: str, weights: dict[str, float], sizes: DataFrame | None = None, direct: str = "direct") -> DataFrame:
    """The description with the most weight per group.

    Ties go to a description that a row not from orthology backs, then by name. support is its share of the weight,
    coverage the share of the group's members (sizes: group, size) that have a description, capped at 1.
    Sources that weights doesn't name weigh 1; empty groups are left out.
    """
    weight = F.coalesce(*[F.when(F.col(source) == k, F.lit(v)) for k, v in weights.items()], F.lit(1.0))
    is_direct = (F.col(source) == direct).cast("int")
    votes = rows.where(F.col(group).isNotNull() & (F.col(group).cast("string") != ""))
    by = votes.groupBy(group, description).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"), F.sum(is_direct).alias("_d"))
    # One row per group and description from here on: the window sees descriptions, not members.
    total = by.groupBy(group).agg(
        F.min_by(F.struct(F.col(description).alias("name"), F.col("_w").alias("w"), F.col("_d").alias("d")), F.struct(-F.col("_w"), F.col("_d") == 0, F.col(description))).alias("top"),
        F.sum("_w").alias("_total"),
        F.sum("_n").alias("n_annotated"),
        F.sum("_d").alias("n_direct"),
    )
    out = total.select(
        group,
        F.col("top.name").alias("name"),
        (F.col("top.w") / F.col("_total")).alias("support"),
        "n_annotated",
        "n_direct",
        (F.col("n_annotated") - F.col("n_direct")).alias("n_orthology"),
        F.when(F.col("top.d") > 0, "direct").otherwise("orthology").alias("provenance"),
    )
    if sizes is None:
        return out.withColumns({"group_size": F.lit(None).cast("long"), "coverage": F.lit(None).cast("double")})
    met = out.join(sizes.select(group, F.col("size").alias("group_size")), group, "left")
    return met.withColumn("coverage", F.when(F.col("group_size") > 0, F.least(F.lit(1.0), F.col("n_annotated") / F.col("group_size"))))


def direct_over_orthology(direct: DataFrame, orthology: DataFrame, key: str) -> DataFrame:
    """Direct rows, and those orthology rows whose key has none."""
    return direct.unionByName(orthology.join(direct.select(key).distinct(), key, "left_anti"))


def consensus(rows: DataFrame, group: str, value: str, min_agree: float = 0.5) -> DataFrame:
    """The value most voters of a group have: null if two share the first place or its share is below min_agree."""
    by = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    top = by.groupBy(group).agg(F.max("_n").alias("_top"), F.sum("_n").alias("n_voters"), F.max_by(value, "_n").alias("_value"), F.sort_array(F.collect_list("_n"), False).alias("_all"))
    # The list has an entry per distinct value of the group.
    tied = F.coalesce(F.get("_all", F.lit(1)) == F.col("_top"), F.lit(False))
    share = F.col("_top") / F.col("n_voters")
    return top.select(group, F.when(~tied & (share >= min_agree), F.col("_value")).alias("consensus"), share.alias("share"), "n_voters")


def disagreements(rows: DataFrame, decided: DataFrame, group: str, value: str) -> DataFrame:
    """Voters whose value isn't their group's consensus."""
    return rows.where(F.col(value).isNotNull()).join(decided.where("consensus IS NOT NULL").select(group, "consensus"), group).where(F.col(value) != F.col("consensus"))


def merge_candidates(hits: DataFrame, members: DataFrame, gene: str, family: str, bits: str, gate: Column, min_reciprocal: float = 0.6) -> DataFrame:
    """Pairs of families whose members hit each other's family best: family_a < family_b, fraction (of the less willing side)."""
    own = members.select(gene, F.col(family).alias("own"))
    sizes = own.groupBy("own").agg(F.countDistinct(gene).alias("size"))
    votes = best_hit(hits.where(gate).join(own, gene).where(F.col(family) != F.col("own")), [gene, "own"], [F.col(bits).desc(), F.col(family)])
    frac = votes.groupBy("own", F.col(family).alias("other")).agg(F.count("*").alias("n")).join(sizes, "own").select("own", "other", (F.col("n") / F.col("size")).alias("frac"))
    back = frac.select(F.col("own").alias("other"), F.col("other").alias("own"), F.col("frac").alias("frac_back"))
    both = frac.where("own < other").join(back, ["own", "other"]).withColumn("fraction", F.least("frac", "frac_back"))
    return both.where(F.col("fraction") >= min_reciprocal).select(F.col("own").alias("family_a"), F.col("other").alias("family_b"), "fraction")


def purities(rows: DataFrame, group: str, ranks: list[str], member: str) -> DataFrame:
    """group, rank, purity: the share of the most frequent taxon of each rank. A null taxon counts as one of its own member."""
    ranked = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.coalesce(F.col(r).cast("string"), F.concat(F.lit("unknown:"), F.col(member).cast("string"))).alias("taxon")) for r in ranks]))
    by = rows.select(group, ranked.alias("x")).groupBy(group, "x.rank", "x.taxon").agg(F.count("*").alias("n"))
    return by.groupBy(group, "rank").agg((F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("n_members"))


def rollup(rows: DataFrame, verdict: str, buckets: dict[str, list[str]]) -> DataFrame:
    """Counts per bucket of verdicts; buckets without rows count 0."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(b, v) for b, vs in buckets.items() for v in vs], "bucket string, verdict string")
    n = rows.groupBy(F.col(verdict).alias("verdict")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(n, "verdict", "left").groupBy("bucket").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def unordered_best(pairs: DataFrame, a: str, b: str, score: str, rows: int | None = None) -> DataFrame:
    """The best score of each unordered pair of different ids. rows: about how many pairs there are; more of them take more tasks."""
    both = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(score).alias("_score"))
    both = both if rows is None else spread(both, rows, "a", "b")
    return both.groupBy("a", "b").agg(F.max("_score").alias("best"))


def coherence(groups: DataFrame, pairs: DataFrame, member: str, group: str) -> DataFrame:
    """Mean pair score within each group and to other groups, over observed pairs with both ends grouped.

    coherent: within above between; null unless both were observed.
    """
    ga = groups.select(F.col(member).alias("a"), F.col(group).alias("ga"))
    gb = groups.select(F.col(member).alias("b"), F.col(group).alias("gb"))
    met = pairs.join(ga, "a").join(gb, "b")
    ends = met.select(F.explode(F.array_distinct(F.array("ga", "gb"))).alias(group), (F.col("ga") == F.col("gb")).alias("inside"), "best")
    n = ends.groupBy(group).agg(F.avg(F.when(F.col("inside"), F.col("best"))).alias("within"), F.avg(F.when(~F.col("inside"), F.col("best"))).alias("between"), F.count("*").alias("n_pairs"))
    return n.withColumn("coherent", F.col("within") > F.col("between"))


def single_copy(members: DataFrame, group: str, species: str, wanted: list[str]) -> DataFrame:
    """Groups with exactly one member of each wanted species and none of another."""
    n = members.groupBy(group).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(species)).alias("s"))
    return n.where((F.col("n") == len(wanted)) & (F.col("s") == F.array(*map(F.lit, sorted(wanted))))).select(group)


def splice_report(scores: DataFrame, gene: str, isoform: str, score: str, min_gap: float) -> DataFrame:
    """Isoforms ranked by score within their gene, the gap to the best, and whether it reaches min_gap. Unscored ones are left out."""
    w = Window.partitionBy(gene).orderBy(F.col(score).desc(), F.col(isoform))
    best = F.max(score).over(Window.partitionBy(gene))
    out = scores.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w).cast("long")).withColumn("gap", best - F.col(score))
    return out.withColumn("flagged", F.col("gap") >= min_gap)
