"""Mixing of sources to target weights: how often each document enters a training mix.

Words are summed by source, the total is shared by weight up to a bound of repetition per source, and each
source's target over its size is the rate of its documents: floor(rate) copies and one more with the
probability of the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import fresh, global_index, need, scratch, staged
from cladeframe.stage import in_ranges

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Sources that are broadcast at most (some 100 bytes each); beyond it their rows are joined by a shuffle over SALTS.
BROADCAST_SOURCES = 100_000
SALTS = 16


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(value: Column) -> Column:
    """A number in [0, 1) that the value's MD5 decides."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size; one row each, staged) with weight and target.

    Sources in order of code points, null last, take the weights in turn. A target is level * weight, at most `most`
    times the source's size, and the level makes the targets sum to all sizes. For any k, taking the k sources with the
    smallest size per weight at their bounds and sharing the rest among the others by weight gives a level that is the
    right one or too low, so the largest of these is the level: one running sum instead of rounds of resharing.
    """
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    weighed = global_index(sources, [F.col("source").asc_nulls_last()], "_at", "mix-sources").withColumn("weight", w).drop("_at")
    ratio = weighed.withColumn("_ratio", F.col("source_size") / F.col("weight"))
    keys = ["_ratio", "source"]
    fixed = in_ranges(ratio, keys, "mix-levels")
    # One row per range, and one for the whole.
    sums = fixed.groupBy("_range").agg(F.sum("source_size").alias("_s"), F.sum("weight").alias("_w"))
    before = sums.selectExpr("_range", "sum(_s) OVER (ORDER BY _range) - _s AS _s0", "sum(_w) OVER (ORDER BY _range) - _w AS _w0", "sum(_s) OVER () AS _total", "sum(_w) OVER () AS _weights")
    inside = "OVER (PARTITION BY _range ORDER BY _ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = fixed.join(F.broadcast(before), "_range").selectExpr("_total", "_weights", f"_s0 + sum(source_size) {inside} - source_size AS _capped", f"_w0 + sum(weight) {inside} - weight AS _done")
    level = run.agg(F.max((F.col("_total") - most * F.col("_capped")) / (F.col("_weights") - F.col("_done"))).alias("_level"))
    bound = (most * F.col("source_size")).cast("double")
    return weighed.crossJoin(F.broadcast(level)).select("source", "source_size", "weight", F.least(bound, F.col("weight") * F.col("_level")).alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """rows (_source, ...) joined with their source's row; a hot source is dealt over SALTS where sources are too many to broadcast."""
    if few:
        return rows.join(F.broadcast(sources), rows["_source"].eqNullSafe(sources["source"]))
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_own_salt", F.pmod(F.xxhash64("_seed", "_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt["_source"].eqNullSafe(salted["source"]) & (dealt["_own_salt"] == salted["_salt"])).drop("_salt", "_own_salt")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, balanced: bool = True, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    A document has floor(rate) copies, and one more by a Bernoulli draw with the fraction of the rate as probability. Draws
    of a source that are independent (balanced=False: seeded by the hash of the id) miss its target by a share that falls with
    the root of its number of documents, a quarter for fifty. Balanced draws start at a hash of the source and go through its
    documents by size (then hash of the id) in steps of the fraction: each document has the same probability as before, and what
    a source takes differs from its target by about its longest document at most. Both repeat on a rerun.

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Null ids are one id. Repeated rows
    each get a row. Sources without words have target 0. An empty table gives an empty result. Other columns of docs
    are ignored. Texts aren't shuffled: an id, a name, a size and a hash of each document are.
    """
    need(docs, key, source, text)
    spark = docs.sparkSession
    ident = F.col(key).cast("long")
    rows = docs.select(
        ident.alias("_id"),
        F.col(source).cast("string").alias("_source"),
        word_count(F.col(text).cast("string")).alias("size"),
        F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")).alias("_seed"),
    )
    with scratch(spark):
        rows = staged(rows, "mix-sizes")
        if balanced:
            rows = staged(global_index(rows, [F.col("_source").asc_nulls_last(), F.col("size"), F.col("_seed"), F.col("_id")], "_row", "mix-order"), "mix-rows")
        else:
            rows = rows.withColumn("_row", F.lit(0).cast("long"))
        sources = staged(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.min("_row").alias("_first")), "mix-sums")
        few = sources.count() <= BROADCAST_SOURCES
        targets = source_targets(sources.drop("_first"), weights, most).withColumnRenamed("source", "_name")
        known = staged(sources.join(targets.drop("source_size"), sources["source"].eqNullSafe(targets["_name"])).drop("_name", "weight"), "mix-targets")
        met = _with_sources(rows, known, few)
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        met = met.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate")).withColumn("_part", F.col("_rate") - F.col("_whole"))
        if balanced:
            start = fraction(F.concat(F.lit("mix:"), F.coalesce("source", F.lit(""))))
            at = F.col("_row") - F.col("_first")
            more = F.floor(F.col("_part") * (at + 1) + start) > F.floor(F.col("_part") * at + start)
        else:
            more = F.conv(F.substring("_seed", 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)) < F.col("_part")
        copies = F.col("_whole") + more.cast("long")
        out = met.select(F.col("_id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
        return staged(out, "mix", lasting=True)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, balanced: bool = True, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, with copy (from 1), for docs with one row an id.

    Documents without words are taken as often as their rate says. ValueError if an id is null or repeats.
    """
    plan = mixture(docs, weights, most, balanced, key, source, text).select("doc_id", "copies")
    if not plan.where("doc_id IS NULL").isEmpty() or not plan.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("ids are null or repeat")
    name, copy = fresh(docs, "_copies"), fresh(docs, "copy")
    plan = plan.where("copies > 0").select(F.col("doc_id").alias(fresh(docs, "_mixed")), F.col("copies").alias(name))
    met = docs.join(plan, docs[key].cast("long") == plan[plan.columns[0]]).drop(plan.columns[0])
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name).cast("int")))).drop(name)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target and the words the mix takes of it; nulls, ties and repeats as in mixture()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS pos FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (SELECT sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, sum(source_size) OVER o - source_size AS capped, sum(weight) OVER o - weight AS done FROM w
  WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT max(CAST(total - 3 * capped AS DOUBLE) / CAST(weights - done AS DOUBLE)) AS level FROM c),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * level) AS target,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS start FROM w, l),
p AS (SELECT r.doc_id, r.size, r.pos, t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS part FROM p),
m AS (SELECT *, whole + CASE WHEN floor(part * (pos + 1) + start) > floor(part * pos + start) THEN 1 ELSE 0 END AS copies FROM q)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM m"""
