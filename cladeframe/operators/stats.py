"""Multiple testing, rank tests and the placement audits' rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.exprs import erfc
from cladeframe.operators.sets import BROADCAST_ROWS
from cladeframe.stage import in_ranges, running_sum, staged


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """df with q: the least p*n/rank of this p-value and all larger ones, at most 1. Null p-values have a null q.

    Equal p-values share the largest rank, so one row per distinct p-value is enough for the running minimum. The
    distinct values are dealt into ranges of near equal counts, wherever they crowd; a row per range goes through one window.
    """
    distinct = in_ranges(df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_c")), [p], "p-values")
    upto = distinct.groupBy("_range").agg(F.sum("_c").alias("_c")).selectExpr("_range", "sum(_c) OVER (ORDER BY _range) - _c AS _before", "sum(_c) OVER () AS _total")
    inside = Window.partitionBy("_range").orderBy(p)
    ranks = distinct.join(F.broadcast(upto), "_range").withColumn("_rank", F.col("_before") + F.sum("_c").over(inside)).withColumn("_raw", F.col(p) * F.col("_total") / F.col("_rank"))
    lows = ranks.groupBy("_range").agg(F.min("_raw").alias("_low"))
    after = lows.selectExpr("_range", "min(_low) OVER (ORDER BY _range DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _after")
    falling = Window.partitionBy("_range").orderBy(F.col(p).desc())
    q = ranks.join(F.broadcast(after), "_range").withColumn("q", F.least(F.min("_raw").over(falling), F.coalesce("_after", F.lit(1.0)), F.lit(1.0)))
    return df.join(q.select(p, "q"), p, "left")


def group_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the exact median of value by key, as F.median gives it (nulls are left out), for keys of any size.

    Equal values of a key are counted first; the distinct ones are dealt into ranges over all keys, so a key with
    most rows spreads over most ranges. Counts by key and range say which one or two ranges hold a key's middle, and only
    rows of these are ranked, each range on its own: no task holds a key.
    """
    return _medians(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")), keys, value, name)


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def _medians(counted: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The medians of counted values (_c). Where only values near the middle are there, _skip counts a key's lower ones and _all all of them."""
    part = "_skip" in counted.columns
    fixed = in_ranges(counted, [*keys, value], "medians")
    by_range = Window.partitionBy(*keys).orderBy("_range")
    # A row per key and range that it reaches.
    held = fixed.groupBy(*keys, "_range").agg(F.sum("_c").alias("_in"), *[F.first(c).alias(c) for c in ("_skip", "_all") if part])
    held = held.withColumn("_upto", F.sum("_in").over(by_range) + (F.col("_skip") if part else F.lit(0))).withColumn("_n", F.col("_all") if part else F.sum("_in").over(Window.partitionBy(*keys)))
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    middle = held.withColumns({"_low": low, "_high": high, "_before": F.col("_upto") - F.col("_in")}).where("_before <= _high AND _upto > _low")
    to = [f"_k{i}" for i in range(len(keys))]
    middle = middle.select(*[F.col(k).alias(t) for k, t in zip(keys, to, strict=True)], F.col("_range").alias("_r"), "_before", "_low", "_high")
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    ranked = fixed.join(middle, _same([*keys, "_range"], [*to, "_r"])).withColumn("_last", F.col("_before") + F.sum("_c").over(inside))
    hit = ranked.where("_last > _low AND _last - _c <= _high")
    return hit.groupBy(*keys).agg(((F.min(value) + F.max(value)) / F.lit(2.0)).alias(name))


def _bin(value: str) -> Column:
    """A long that never falls as value grows: 64 bins for each factor of e, of either sign."""
    v = F.col(value).cast("double")
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(1000.0)) * 64) + 100_000
    return F.when(F.isnan(v), F.lit(1_000_000)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def dense_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """As group_medians, of a number, for rows that are too many to shuffle and cheap to make twice.

    Rows are counted by key and bin where they are, and only those in the bins that hold a key's middle are counted by value,
    shuffled and ranked. A bin of any size is ranked, as group_medians ranks a key.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_bin", _bin(value))
    upto = Window.partitionBy(*keys).orderBy("_bin")
    held = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_in"))
    held = held.withColumns({"_upto": F.sum("_in").over(upto), "_all": F.sum("_in").over(Window.partitionBy(*keys))}).withColumn("_before", F.col("_upto") - F.col("_in"))
    middle = held.where("_before <= _all div 2 AND _upto > (_all - 1) div 2").withColumn("_skip", F.min("_before").over(Window.partitionBy(*keys)))
    to = [f"_k{i}" for i in range(len(keys))]
    middle = staged(middle.select(*[F.col(k).alias(t) for k, t in zip(keys, to, strict=True)], F.col("_bin").alias("_b"), "_skip", "_all"), "middle-bins")
    few = F.broadcast(middle) if middle.count() <= BROADCAST_ROWS else middle
    near = rows.join(few, _same([*keys, "_bin"], [*to, "_b"]))
    return _medians(near.groupBy(*keys, value).agg(F.count("*").alias("_c"), F.first("_skip").alias("_skip"), F.first("_all").alias("_all")), keys, value, name)


def mann_whitney(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """One row: n_a, n_b, u (of the first group), z, p. Ties share their mean rank; normal approximation without corrections.

    p is null if a group is empty and 1 if the deviation is 0. Ranks are taken over distinct values.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.count_if(is_first).alias("a"))
    ranked = running_sum(by, [value], "n", "upto", "ranks").withColumn("r", F.col("upto") - (F.col("n") - 1) / 2)
    s = ranked.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("n") - F.sum("a"), F.lit(0)).alias("n_b"), F.sum(F.col("r") * F.col("a")).alias("ra"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb * (na + nb + 1) / 12)
    z = F.when(sd > 0, (u - na * nb / 2) / sd)
    out = s.select("n_a", "n_b", u.alias("u"), z.alias("z"), (na * nb).alias("_pairs"))
    p = F.when(F.col("_pairs") == 0, F.lit(None).cast("double")).when(F.col("z").isNull(), F.lit(1.0)).otherwise(erfc(F.abs("z") / F.sqrt(F.lit(2.0))))
    return out.withColumn("p", p).drop("_pairs")


def short_fractions(lengths: DataFrame, species: str, length: str, floor: int = 100) -> DataFrame:
    n = lengths.groupBy(species).agg(F.min(length).alias("min_length"), F.count_if(F.col(length) < floor).alias("n_short"), F.count("*").alias("n"))
    return n.withColumn("short_fraction", F.col("n_short") / F.col("n"))


def confound(fractions: DataFrame, limit: float = 3.0) -> DataFrame:
    """One row: whether species differ so much in short sequences that their rates can't be compared."""
    s = fractions.agg(F.min("short_fraction").alias("lowest"), F.max("short_fraction").alias("highest"))
    return s.withColumn("confounded", F.when((F.col("lowest") == 0) & (F.col("highest") > 0), True).when(F.col("lowest") == 0, False).otherwise(F.col("highest") / F.col("lowest") > limit))


def stratified_rates(genes: DataFrame, species: str, length: str, unplaced: Column, floor: int = 100) -> DataFrame:
    stratum = F.when(F.col(length) < floor, "short").otherwise("long").alias("stratum")
    n = genes.groupBy(species, stratum).agg(F.count("*").alias("n"), F.count_if(unplaced).alias("n_unplaced"))
    return n.withColumn("rate", F.col("n_unplaced") / F.col("n"))


def running_offsets(loci: DataFrame, order: str, width: str) -> DataFrame:
    """start, end (1-based, inclusive) of each locus when they are put one after another in the order of a column without repeats."""
    return running_sum(loci, [order], width, "end", "offsets").withColumn("start", F.col("end") - F.col(width) + 1)


def unplaced_verdicts(observations: DataFrame, gene: str, n_genes: str, n_other: str, cross_hit: str, min_size: int = 4) -> DataFrame:
    """Why a gene is in no family, from the groups it was seen in: the strongest evidence of all rounds."""
    cross = (F.col(n_other) > 0) & (F.col(n_genes) >= 2)
    f = observations.groupBy(gene).agg(
        F.bool_or(cross & (F.col(n_genes) >= min_size)).alias("_p"), F.bool_or(cross).alias("_s"), F.bool_or(F.col(n_genes) >= 2).alias("_l"), F.bool_or(cross_hit).alias("_h")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return f.select(gene, F.when(yes("_p"), "PRUNED").when(yes("_s"), "SPLINTER").when(yes("_l"), "LINEAGE_ONLY").when(yes("_h"), "SINGLETON_HIT").otherwise("SINGLETON_NOHIT").alias("verdict"))
