"""Best hits, margins to the second, and ambiguity. Ties are never broken by the order of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_hit(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in a total order. A bare row_number filter lets Spark cut groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def top_two(df: DataFrame, keys: list[str], score: str, order: list[Column], carry: list[str]) -> DataFrame:
    """keys, the carried columns of the best row, its score, and second: the score of the next (null if alone).

    Two rows a key are cut out first and then folded, so a hot key is reduced before the shuffle.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn <= 2")
    first = F.col("_rn") == 1
    out = ranked.groupBy(*keys).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in carry],
        F.max(F.when(first, F.col(score))).alias(score),
        F.max(F.when(~first, F.col(score))).alias("second"),
    )
    return out


def with_margin(df: DataFrame, key: str, candidate: str, score: str, gates: Column, margin: Column, strict: bool = False) -> DataFrame:
    """Assign each key to its best candidate: the gates are asked of the best hit alone, then the margin to the second.

    status: gated (the best fails a gate), ambiguous (only the margin fails) or assigned. With strict, an equal
    second is ambiguous even where the margin is 0. margin is an expression over the score column.
    """
    rows = df.withColumn("_ok", gates)
    two = top_two(rows, [key], score, [F.col(score).desc(), F.col(candidate)], [candidate, "_ok"])
    enough = F.col("second").isNull() | (F.col(score) - F.col("second") >= margin)
    if strict:
        enough = enough & (F.col("second").isNull() | (F.col(score) > F.col("second")))
    status = F.when(~F.coalesce("_ok", F.lit(False)), "gated").when(enough, "assigned").otherwise("ambiguous")
    return two.withColumn("status", status).drop("_ok")


def ambiguous_candidates(df: DataFrame, decided: DataFrame, key: str, candidate: str, score: str, k: int = 5) -> DataFrame:
    """The k best candidates of each ambiguous key, with their rank from 1."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(candidate))
    open_ = decided.where("status = 'ambiguous'").select(key)
    return df.join(open_, key, "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, candidate, score, F.col("rank").cast("long").alias("rank"))


def reassignments(hits: DataFrame, current: DataFrame, key: str, family: str, nbits: str, profile_cov: str, margin: float = 0.15, min_cov: float = 0.6) -> DataFrame:
    """Genes that another family fits better by a margin than their own: key, from_family, to_family, gain.

    A gene without a hit to its own family counts as 0 there.
    """
    own = current.select(key, F.col(family).alias("from_family"))
    met = hits.join(own, key)
    now = F.coalesce(F.max(F.when(F.col(family) == F.col("from_family"), F.col(nbits))).over(Window.partitionBy(key)), F.lit(0.0))
    scored = met.withColumn("gain", F.col(nbits) - now).where((F.col(family) != F.col("from_family")) & (F.col(profile_cov) >= min_cov) & (F.col("gain") >= margin))
    top = best_hit(scored, [key], [F.col(nbits).desc(), F.col(family)])
    return top.select(key, "from_family", F.col(family).alias("to_family"), "gain")


def reciprocal_best(forward: DataFrame, reverse: DataFrame, query: str, subject: str, group: str | None = None) -> DataFrame:
    """forward (query, subject[, group]) with rbh: whether the subject's best hit (in the query's group) is the query."""
    on = [subject] + ([group] if group else [])
    back = reverse.select(*on, F.col(query).alias("_back"))
    return forward.join(back, on, "left").withColumn("rbh", F.when(F.col("_back").isNull(), F.lit("")).when(F.col("_back") == F.col(query), F.lit("yes")).otherwise(F.lit("no"))).drop("_back")


def family_mass(placements: DataFrame, key: str, family: str, weight: str, pendant: str, floor: float = 0.2, margin: float = 0.0, max_pendant: float = 0.0) -> DataFrame:
    """Families by their summed weight: the best if it reaches the floor, leads by the margin, strictly, and its
    heaviest placement isn't too far out; else null. Placements without a family don't count."""
    sums = placements.where(F.col(family).isNotNull()).groupBy(key, family).agg(F.sum(weight).alias("mass"), F.max_by(pendant, weight).alias("pendant"))
    two = top_two(sums, [key], "mass", [F.col("mass").desc(), F.col(family)], [family, "pendant"])
    ok = (F.col("mass") >= floor) & (F.col("second").isNull() | ((F.col("mass") > F.col("second")) & (F.col("mass") - F.col("second") >= margin)))
    if max_pendant > 0:
        ok = ok & (F.col("pendant") <= max_pendant)
    return two.select(key, F.when(ok, F.col(family)).alias(family), "mass", "second")


def placement(placements: DataFrame, key: str, edge: str, weight: str, pendant: str, floor: float = 0.2, margin: float = 0.0, max_pendant: float = 0.0) -> DataFrame:
    """The same by single edge."""
    two = top_two(placements, [key], weight, [F.col(weight).desc(), F.col(edge)], [edge, pendant])
    ok = (F.col(weight) >= floor) & (F.col("second").isNull() | ((F.col(weight) > F.col("second")) & (F.col(weight) - F.col("second") >= margin)))
    if max_pendant > 0:
        ok = ok & (F.col(pendant) <= max_pendant)
    return two.select(key, F.when(ok, F.col(edge)).alias(edge), weight, "second")


def embedding_tiebreak(queries: DataFrame, members: DataFrame, key: str, vector: str, family: str, min_delta: float = 0.02) -> DataFrame:
    """Each query's candidate family by mean cosine to its members: the best if it leads by min_delta or is alone.

    queries: key, vector, candidates (array of families); members: family, vector. Families without members can't win.
    The mean cosine to a family is the dot product with the mean of its members' unit vectors, so queries meet one row
    per candidate family and not its members. Zero vectors count as cosine 0.
    """
    from cladeframe.functions.exprs import dot

    unit = F.posexplode(F.transform(vector, lambda x: F.coalesce(x.cast("double") / F.nullif(F.sqrt(dot(F.col(vector), F.col(vector))), F.lit(0.0)), F.lit(0.0))))
    parts = members.select(family, unit.alias("_i", "_x")).groupBy(family, "_i").agg(F.avg("_x").alias("_x"))
    centre = parts.groupBy(family).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias("_m"))
    norm = F.sqrt(dot(F.col("_q"), F.col("_q")))
    asked = queries.select(key, F.col(vector).alias("_q"), F.explode("candidates").alias(family))
    means = asked.join(centre, family).select(key, family, F.when(norm == 0, F.lit(0.0)).otherwise(dot(F.col("_q"), F.col("_m")) / norm).alias("similarity"))
    two = top_two(means, [key], "similarity", [F.col("similarity").desc(), F.col(family)], [family])
    sure = F.col("second").isNull() | (F.col("similarity") - F.col("second") >= min_delta)
    return two.select(key, F.when(sure, F.col(family)).alias(family), "similarity", "second")
