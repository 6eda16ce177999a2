"""Anti, semi and outer joins that audit and merge sets of genes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.ids import dots_folded, species_of
from cladeframe.stage import staged


def partition_excluded(pool: DataFrame, species: str, excluded: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The pool without the excluded species, the excluded part, and the excluded names that the pool has none of."""
    hit = F.coalesce(F.col(species).isin(excluded), F.lit(False))
    seen = {r[0] for r in pool.where(hit).select(species).distinct().collect()}  # at most the names given
    return pool.where(~hit), pool.where(hit), sorted(set(excluded) - seen)


def orphans(genes: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    return genes.join(placed.select(key).distinct(), key, "left_anti")


def conservation_audit(pool: DataFrame, placed: DataFrame, recycled: DataFrame, key: str) -> DataFrame:
    """Genes that entered a round and were neither placed nor recycled: they must be put back."""
    return orphans(orphans(pool, placed, key), recycled, key)


def id_agreement(left: DataFrame, right: DataFrame, key: str, group: str) -> DataFrame:
    """By group: ids on the left, on the right, shared, and the shared percentage of the left (0 if it has none)."""
    a = left.select(key, F.col(group).alias("_ga")).distinct().withColumn("_a", F.lit(1))
    b = right.select(key, F.col(group).alias("_gb")).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer").withColumn(group, F.coalesce("_ga", "_gb"))
    n = both.groupBy(group).agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_shared"))
    return n.withColumn("pct_shared", F.when(F.col("n_left") > 0, F.lit(100.0) * F.col("n_shared") / F.col("n_left")).otherwise(F.lit(0.0)))


def axis_matrix(axes: list[tuple[str, DataFrame]], key: str, fold=dots_folded) -> DataFrame:
    """A full outer merge of any number of axes in one shuffle: a row per canonical id, a struct column per axis.

    The id shown prefers a spelling with a dot, else that of the first axis in order.
    """
    parts = []
    for i, (name, df) in enumerate(axes):
        others = [c for c in df.columns if c != key]
        parts.append(df.select(fold(F.col(key).cast("string")).alias("_canon"), F.col(key).cast("string").alias("_shown"), F.lit(i).alias("_axis"), F.struct(*others).alias(name)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    shown = F.min_by("_shown", F.struct((~F.contains("_shown", F.lit("."))).cast("int"), F.col("_axis"), F.col("_shown")))
    merged = union.groupBy("_canon").agg(shown.alias(key), *[F.max_by(name, F.when(F.col(name).isNotNull(), F.lit(1))).alias(name) for name, _ in axes])
    return merged.drop("_canon")


def merge_authoritative(first: DataFrame, second: DataFrame, key: str, value: str, confidence: str) -> DataFrame:
    """Full outer merge in which the first source's value wins unless it is empty; agree is null for a single source."""
    a = first.select(key, F.col(value).alias("_v1"), F.col(confidence).alias("_c1"))
    b = second.select(key, F.col(value).alias("_v2"), F.col(confidence).alias("_c2"))
    v1, v2 = F.nullif(F.col("_v1"), F.lit("")), F.nullif(F.col("_v2"), F.lit(""))
    out = a.join(b, key, "full_outer")
    return out.select(
        key,
        F.coalesce(v1, v2, F.lit("")).alias(value),
        F.when(v1.isNotNull(), F.col("_c1")).otherwise(F.coalesce("_c2", "_c1")).alias(confidence),
        F.when(v1.isNotNull() & v2.isNotNull(), F.lit("both")).when(v1.isNotNull(), F.lit("first")).when(v2.isNotNull(), F.lit("second")).otherwise(F.lit("none")).alias("source"),
        F.when(v1.isNotNull() & v2.isNotNull(), v1 == v2).alias("agree"),
    )


def verdict(supports: list[tuple[str, Column]], contradicts: list[tuple[str, Column]], enough: int = 2) -> list[Column]:
    """member with enough supporting axes, intruder with contradicting ones alone, else review. Null evidence abstains."""
    yes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in supports]))
    no = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in contradicts]))
    what = F.when(F.size(yes) >= enough, "member").when((F.size(yes) == 0) & (F.size(no) > 0), "intruder").otherwise("review")
    return [what.alias("verdict"), F.size(yes).cast("long").alias("n_support"), F.size(no).cast("long").alias("n_contradict"), F.array_join(yes, ",").alias("support_axes"), F.array_join(no, ",").alias("contradict_axes")]


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """base with the rows of over in place of those that share a key."""
    return base.join(over.select(key).distinct(), key, "left_anti").unionByName(over)


def cross_species_hits(hits: DataFrame, query: str, subject: str, evalue: str, wanted: DataFrame, max_evalue: float, delimiter: str = "_") -> DataFrame:
    """The wanted genes that hit a gene of another species."""
    other = hits.where((F.col(evalue) <= max_evalue) & (species_of(F.col(query), delimiter) != species_of(F.col(subject), delimiter)))
    return wanted.join(other.select(query).distinct(), query, "left_semi")


#: Rows of a looked-up side that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def lookup(big: DataFrame, small: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """big joined with small, which has one row a key: broadcast if it is small, as counted.

    Beyond that both are shuffled, but for keys with more than a share of 1/parts of big's rows: these are at most `parts`, so
    what small knows of them is broadcast. big must be cheap to read twice (staged).
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys)
    parts = parts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = big.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = big.count() / parts
    hot = staged(n.where(F.col("_n") > most).select(*keys), "hot-keys")
    met = small.join(F.broadcast(hot), keys, "left_semi")
    rest = big.join(F.broadcast(hot), keys, "left_anti")
    return big.join(F.broadcast(met), keys).unionByName(rest.join(small, keys))


def interval_matches(points: DataFrame, point: str, windows: DataFrame, lo: str, hi: str, by: list[str] | None = None) -> DataFrame:
    """Each row of points (distinct in `by` and point) with each window lo..hi (inclusive) that holds it, windows of any width.

    A window of n positions lies in one or two bins of the smallest power of two that isn't below n; a point looks into its
    bin of each width that any window has, 63 at most. Half of a bin at least is the window's, so what is looked at and
    thrown away stays in proportion to the result. Windows without a bound, or that end before they begin, hold nothing.
    """
    by = by or []
    n = F.col(hi).cast("long") - F.col(lo).cast("long")
    known = windows.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi)))
    sized = known.withColumn("_level", F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n))))
    bin_of = lambda c: F.expr(f"shiftright(CAST(`{c}` AS BIGINT), _level)")
    spread = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(lo), bin_of(hi)))))
    # One row: the widths there are.
    levels = sized.agg(F.collect_set("_level").alias("_levels"))
    at = points.where(F.col(point).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_bin", bin_of(point))
    inside = (F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))
    return at.join(spread, [*by, "_level", "_bin"]).where(inside).drop("_level", "_bin")


def interval_overlaps(sites: DataFrame, site: str, windows: DataFrame, lo: str, hi: str, by: list[str] | None = None) -> DataFrame:
    """All sites, each with the windows that hold it, nulls where none does; by: columns that must agree, as a contig.

    A site's position is looked up once however many sites share it.
    """
    by = by or []
    met = interval_matches(sites.select(*by, site).distinct(), site, windows, lo, hi, by)
    return sites.join(met, [*by, site], "left")


def interval_summary(sites: DataFrame, site: str, windows: DataFrame, lo: str, hi: str, by: list[str] | None = None) -> DataFrame:
    """All sites, each with n_windows, narrowest and widest (hi - lo; null without any) of the windows that hold it: matches are counted, never listed.

    With 2**k <= hi - lo < 2**(k + 1) a window ends in the next bin of 2**k positions or the one after: it holds its first bin from lo on, its last
    up to hi and at most one whole bin between. Windows with the same piece are one row, a position is a row per width there is, and
    in each bin a pass from either end sums the pieces met: work in proportion to windows and positions, however many meet. A bin's
    rows are sorted in one task. Windows without a bound, or that end before they begin, hold nothing.
    """
    by = by or []
    known = windows.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi)))
    sized = known.select(*by, F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi")).withColumn("_width", F.col("_hi") - F.col("_lo"))
    sized = sized.withColumn("_level", F.when(F.col("_width") == 0, F.lit(0)).otherwise(F.length(F.bin("_width")) - 1).cast("int"))
    first, last = F.expr("shiftright(_lo, _level)"), F.expr("shiftright(_hi, _level)")
    opens, asked, closes = 0, 1, 2  # the order of rows at one position
    piece = lambda b, kind, at: F.struct(b.alias("_bin"), F.lit(kind).alias("_kind"), at.alias("_at"))
    middle = F.when(last - first == 2, piece(first + 1, opens, F.expr("shiftleft(shiftright(_lo, _level) + 1, _level)")))
    pieces = F.array_compact(F.array(piece(first, opens, F.col("_lo")), middle, F.when(last > first, piece(last, closes, F.col("_hi")))))
    held = sized.select(*by, "_level", "_width", F.inline(pieces)).groupBy(*by, "_level", "_bin", "_kind", "_at")
    held = held.agg(F.count("*").alias("_n"), F.min("_width").alias("_least"), F.max("_width").alias("_most"))
    # One row: the widths there are.
    levels = sized.agg(F.collect_set("_level").alias("_levels"))
    at = sites.where(F.col(site).isNotNull()).select(*by, F.col(site).cast("long").alias("_at")).distinct().crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels"))
    none = F.lit(None).cast("long")
    at = at.select(*by, "_level", F.expr("shiftright(_at, _level)").alias("_bin"), F.lit(asked).alias("_kind"), "_at", none.alias("_n"), none.alias("_least"), none.alias("_most"))
    bin_ = Window.partitionBy(*by, "_level", "_bin").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda kind, c: F.when(F.col("_kind") == kind, F.col(c))
    passes = ((opens, "_a", bin_.orderBy("_at", "_kind")), (closes, "_b", bin_.orderBy(F.desc("_at"), F.desc("_kind"))))
    sums = [f(of(kind, c)).over(w).alias(f"{c}{end}") for kind, end, w in passes for f, c in ((F.sum, "_n"), (F.min, "_least"), (F.max, "_most"))]
    met = held.unionByName(at).select(*by, "_at", "_kind", *sums).where(F.col("_kind") == asked).groupBy(*by, F.col("_at").alias("_site"))
    n = F.coalesce("_n_a", F.lit(0)) + F.coalesce("_n_b", F.lit(0))
    out = met.agg(F.sum(n).alias("n_windows"), F.min(F.least("_least_a", "_least_b")).alias("narrowest"), F.max(F.greatest("_most_a", "_most_b")).alias("widest"))
    same = F.col(site).cast("long") == F.col("_site")
    for k in by:
        out = out.withColumnRenamed(k, f"_by_{k}")
        same = same & (F.col(k) == F.col(f"_by_{k}"))
    return sites.join(out, same, "left").select(*sites.columns, F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"), "narrowest", "widest")


def union_length(intervals: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """key and covered: the positions that a key's intervals (inclusive) cover together, for keys of any number of intervals.

    Equal intervals count once; overlapping ones form islands over ranges of all keys, and islands' lengths are summed.
    """
    from cladeframe.operators.selection import loci

    islands = loci(intervals.select(key, lo, hi).distinct(), key, lo, hi).groupBy(key, "locus").agg(F.max(hi).alias("_end"))
    return islands.groupBy(key).agg(F.sum(F.col("_end") - F.col("locus") + 1).alias("covered"))


def crossed_windows(sites: DataFrame, site: str, windows: DataFrame, lo: str, hi: str, seq: str, signal: str, by: list[str] | None = None) -> DataFrame:
    """All sites with n_windows, the sequences of their windows in order, and the windows' signals (empty ones left out)."""
    by = by or []
    met = interval_matches(sites.select(*by, site).distinct(), site, windows, lo, hi, by)
    # Counted by sequence and signal first: the lists hold each of them once.
    few = met.groupBy(*by, site, seq, signal).agg(F.count("*").alias("_n"))
    said = few.groupBy(*by, site).agg(F.sum("_n").alias("n_windows"), F.array_join(F.array_sort(F.collect_set(seq)), ",").alias("window_seqs"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(signal), F.lit("")))), ";").alias("signals"))
    return sites.join(said, [*by, site], "left").na.fill(0, ["n_windows"]).na.fill("", ["window_seqs", "signals"])
