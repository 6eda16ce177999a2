"""Alignments by column. An alignment is rows (seq_id, aligned) of equal length, exploded into cells where columns matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.exprs import alignment_digest
from cladeframe.stage import running_sum, staged

GAP = "-"
#: Residues as they are met: cells hold one code point each.
CELLS = "seq_id, col, residue"


def cells(rows: DataFrame, seq_id: str, aligned: str, *carry: str) -> DataFrame:
    """seq_id, col (from 1), residue, and the carried columns. Empty sequences have no cell."""
    chars = F.posexplode(F.split(F.col(aligned), "")).alias("_pos", "residue")
    return rows.where(F.length(aligned) > 0).select(F.col(seq_id).alias("seq_id"), *carry, chars).select("seq_id", *carry, (F.col("_pos") + 1).alias("col"), "residue")


def checked(rows: DataFrame, aligned: str) -> DataFrame:
    """One row n_columns, n_sequences; an error if lengths differ."""
    n = rows.agg(F.min(F.length(aligned)).alias("lo"), F.max(F.length(aligned)).alias("hi"), F.count("*").alias("n_sequences"))
    return n.select(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("sequences of different lengths")).cast("int")).alias("n_columns"), "n_sequences")


def occupancy(cell: DataFrame, *groups: str) -> DataFrame:
    """Share of residues other than gaps by column, and by group where one is named."""
    return cell.groupBy(*groups, "col").agg(F.avg((F.col("residue") != GAP).cast("double")).alias("occupancy"), F.count("*").alias("n"))


def select_columns(cell: DataFrame, threshold: float, group: str | None = None) -> DataFrame:
    """Columns that reach the threshold over all rows, or in any group; all-gap columns never do."""
    occ = occupancy(cell, group) if group else occupancy(cell)
    return occ.groupBy("col").agg(F.max("occupancy").alias("best")).where((F.col("best") >= threshold) & (F.col("best") > 0)).select("col")


def apply_columns(cell: DataFrame, columns: DataFrame) -> DataFrame:
    """seq_id, aligned: the rows with only the columns given, in order."""
    kept = cell.join(columns.select("col"), "col", "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("col", "residue")))
    return kept.groupBy("seq_id").agg(F.array_join(F.transform(parts, lambda x: x["residue"]), "").alias("aligned"))


def tops(cell: DataFrame, group: str) -> DataFrame:
    """By group and column: the most frequent residue (ties to the smaller), its count, the residues and the rows."""
    by = cell.groupBy(group, "col", "residue").agg(F.count("*").alias("c"))
    real = F.col("residue") != GAP
    return by.groupBy(group, "col").agg(
        F.max_by(F.struct("residue", "c"), F.when(real, F.struct(F.col("c"), -F.ascii("residue")))).alias("t"),
        F.sum(F.when(real, F.col("c")).otherwise(0)).alias("filled"),
        F.sum("c").alias("n"),
    ).select(group, "col", F.when(F.col("filled") > 0, F.col("t.residue")).alias("residue"), F.when(F.col("filled") > 0, F.col("t.c")).otherwise(0).alias("c"), "filled", "n")


def invariant_columns(cell: DataFrame, group: str, threshold: float = 0.95, min_cover: float = 0.7) -> DataFrame:
    """col, residue where every group is covered and has the same residue in at least threshold of its filled rows."""
    t = tops(cell, group)
    ok = F.bool_and((F.col("filled") >= F.lit(min_cover) * F.col("n")) & (F.col("filled") > 0) & (F.col("c") >= F.lit(threshold) * F.col("filled")))
    return t.groupBy("col").agg(ok.alias("ok"), F.min("residue").alias("residue"), F.max("residue").alias("_other")).where("ok AND residue = _other").select("col", "residue")


def diagnostic_columns(cell: DataFrame, group: str, min_group: int = 5, in_cons: float = 0.8, out_max: float = 0.2, min_cover: float = 0.7) -> DataFrame:
    """Columns that tell a group from the rest: its top residue is conserved within and rare outside.

    col, group, residue, in_freq, out_freq, cover. Residues outside are the column's totals less the group's own.
    """
    t = tops(cell, group)
    all_filled = cell.where(F.col("residue") != GAP).groupBy("col").agg(F.count("*").alias("all_filled"))
    all_res = cell.where(F.col("residue") != GAP).groupBy("col", "residue").agg(F.count("*").alias("all_c"))
    met = t.where((F.col("n") >= min_group) & (F.col("filled") > 0)).join(all_filled, "col").join(all_res, ["col", "residue"])
    outside = F.col("all_filled") - F.col("filled")
    out = F.when(outside > 0, (F.col("all_c") - F.col("c")) / outside)
    scored = met.select("col", group, "residue", (F.col("c") / F.col("filled")).alias("in_freq"), out.alias("out_freq"), (F.col("filled") / F.col("n")).alias("cover"))
    return scored.where((F.col("cover") >= min_cover) & (F.col("in_freq") >= in_cons) & (F.col("out_freq") <= out_max))


def coverage_suppressed(cell: DataFrame, group: str, min_cover: float = 0.7, min_group: int = 5) -> DataFrame:
    """Groups and columns that were never judged, for want of filled rows or of members."""
    occ = occupancy(cell, group)
    return occ.where((F.col("occupancy") < min_cover) | (F.col("n") < min_group)).select(group, "col", "occupancy", F.when(F.col("n") < min_group, "small group").otherwise("low cover").alias("reason"))


def residue_numbers(cell: DataFrame) -> DataFrame:
    """cells with ungapped: the number of the residue in its own sequence, null at gaps."""
    w = Window.partitionBy("seq_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return cell.withColumn("_k", F.sum((F.col("residue") != GAP).cast("long")).over(w)).withColumn("ungapped", F.when(F.col("residue") != GAP, F.col("_k"))).drop("_k")


def columns_to_residues(cell: DataFrame, seq_id, lo: int, hi: int) -> DataFrame:
    return residue_numbers(cell.where(F.col("seq_id") == seq_id)).where(F.col("col").between(lo, hi) & F.col("ungapped").isNotNull()).select("ungapped")


def choose_reference(rows: DataFrame, seq_id: str, aligned: str, *keys: str) -> DataFrame:
    """The sequence with the most residues, ties to the smaller id, of each key (or of all)."""
    n = F.length(F.replace(F.col(aligned), F.lit(GAP), F.lit("")))
    best = F.min_by(F.struct(F.col(seq_id).alias("reference"), n.cast("long").alias("residues")), F.struct(-n, F.col(seq_id)))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def column_map(cell: DataFrame, columns: DataFrame, reference) -> DataFrame:
    """kept (from 1), col, ref_pos for the columns given, by the residues of a reference sequence."""
    ref = residue_numbers(cell.where(F.col("seq_id") == reference)).select("col", F.col("ungapped").alias("ref_pos"))
    numbered = running_sum(columns.select("col").withColumn("_one", F.lit(1)), ["col"], "_one", "kept", "column-map")
    return numbered.join(ref, "col", "left").select("kept", "col", "ref_pos")


def translate_columns(source: DataFrame, target: DataFrame, via) -> DataFrame:
    """col, to_col: columns of one alignment in another, by a sequence that both hold with the same residues; null at gaps."""
    a = residue_numbers(source.where(F.col("seq_id") == via)).select("col", "ungapped", F.col("residue").alias("_ra"))
    b = residue_numbers(target.where(F.col("seq_id") == via)).where("ungapped IS NOT NULL").select("ungapped", F.col("col").alias("to_col"), F.col("residue").alias("_rb"))
    met = a.join(b, "ungapped", "left")
    wrong = F.col("_ra") != F.col("_rb")
    return met.select("col", F.when(wrong, F.raise_error(F.lit("the sequences differ")).cast("int")).otherwise(F.col("to_col")).alias("to_col"))


def drop_gap_codons(rows: DataFrame, seq_id: str, aligned: str, *keys: str) -> DataFrame:
    """Codon alignments without codons that are gaps in every sequence (of a key): upper case, partial codons dropped."""
    codons = F.regexp_extract_all(F.upper(F.col(aligned)), F.lit("(?s)(...)"), F.lit(1))
    cell = rows.select(*keys, F.col(seq_id).alias("seq_id"), F.posexplode(codons).alias("pos", "codon"))
    kept = cell.groupBy(*keys, "pos").agg(F.bool_or(F.col("codon") != GAP * 3).alias("ok")).where("ok").select(*keys, "pos")
    parts = F.array_sort(F.collect_list(F.struct("pos", "codon")))
    return cell.join(kept, [*keys, "pos"]).groupBy(*keys, "seq_id").agg(F.array_join(F.transform(parts, lambda x: x["codon"]), "").alias("aligned"))


def concatenated(loci: DataFrame, locus: str, species: str, aligned: str) -> DataFrame:
    """species, aligned: all loci one after another in order. Every species must have every locus."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(locus).alias("l"), F.col(aligned).alias("a"))))
    return loci.groupBy(species).agg(F.array_join(F.transform(parts, lambda x: x["a"]), "").alias("aligned"), F.count("*").alias("n_loci"))


def stamp(rows: DataFrame, seq_id: str, aligned: str, *keys: str) -> DataFrame:
    """digest, n_columns, n_sequences of each alignment; the order of its rows doesn't matter."""
    every = F.collect_list(F.struct(F.col(seq_id).cast("string").alias("seq_id"), F.col(aligned).alias("aligned")))
    return rows.groupBy(*keys).agg(alignment_digest(every).alias("digest"), F.max(F.length(aligned)).cast("long").alias("n_columns"), F.count("*").alias("n_sequences"))


def without_stops(rows: DataFrame, aligned: str) -> Column:
    """True for rows whose protein has no stop inside."""
    body = F.rtrim(F.rtrim(F.col(aligned), F.lit("-.")), F.lit("*"))
    return ~F.contains(body, F.lit("*"))


#: What the place of diagnostic columns says, and why nothing can be said.
NEAR, AWAY, INDEPENDENT, UNTESTABLE = "near the core", "away from the core", "independent of the core", "not testable"


def core_relationships(columns: DataFrame, alignment: str, n_null: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Whether the diagnostic columns of alignments lie nearer to their invariant core than as many columns drawn at random.

    columns: alignment, col, diagnostic, core, eligible (booleans; null: no). Returns a row per alignment: n_diagnostic, n_core,
    n_eligible, observed (the median distance to the next core column), null_median, p_near, p_far, verdict. A draw takes
    the eligible columns whose hash of seed, alignment, draw and column is least, so it is the same wherever it runs, and all
    draws of all alignments are groups of one plan. An alignment without a diagnostic, a core or enough eligible
    columns isn't testable. Columns of an alignment lie in one window, as many as the alignment is wide.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    core = F.when(yes("core"), F.col("col"))
    order = Window.partitionBy(alignment).orderBy("col")
    before = F.last(core, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(core, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = columns.select(alignment, "col", yes("diagnostic").alias("diagnostic"), yes("core").alias("core"), yes("eligible").alias("eligible"))
    placed = staged(placed.withColumn("away", F.least(F.col("col") - before, after - F.col("col"))), "core-distances")
    n = placed.groupBy(alignment).agg(F.count_if("diagnostic").alias("n_diagnostic"), F.count_if("core").alias("n_core"), F.count_if("eligible").alias("n_eligible"), F.median(F.when(F.col("diagnostic"), F.col("away"))).alias("observed"))
    testable = (F.col("n_diagnostic") > 0) & (F.col("n_core") > 0) & (F.col("n_eligible") >= F.col("n_diagnostic"))
    pool = placed.where("eligible").join(F.broadcast(n.where(testable)) if n.count() <= 100_000 else n.where(testable), alignment)
    drawn = pool.select(alignment, "col", "away", "n_diagnostic", "observed", F.explode(F.sequence(F.lit(1), F.lit(n_null))).alias("draw"))
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(alignment).cast("string"), F.col("draw").cast("string"), F.col("col").cast("string")).cast("binary"))
    taken = drawn.withColumn("_lot", lot).withColumn("_rank", F.row_number().over(Window.partitionBy(alignment, "draw").orderBy("_lot", "col"))).where("_rank <= n_diagnostic")
    null = taken.groupBy(alignment, "draw").agg(F.median("away").alias("m"), F.first("observed").alias("o"))
    tested = null.groupBy(alignment).agg(F.median("m").alias("null_median"), ((1 + F.count_if(F.col("m") <= F.col("o"))) / F.lit(1.0 + n_null)).alias("p_near"), ((1 + F.count_if(F.col("m") >= F.col("o"))) / F.lit(1.0 + n_null)).alias("p_far"))
    verdict = F.when(F.col("p_near").isNull(), UNTESTABLE).when(F.col("p_near") <= alpha, NEAR).when(F.col("p_far") <= alpha, AWAY).otherwise(INDEPENDENT)
    return n.join(tested, alignment, "left").withColumn("verdict", verdict)


def region_contrast(values: DataFrame, member: str, residue: str, value: str, in_region: Column, focal: Column, min_residues: int = 5) -> DataFrame:
    """By structure: mean value of the region less that of the whole, whether it is focal, and why it was left out if so."""
    n = values.groupBy(member).agg(F.count_if(in_region).alias("n_region"), F.avg(F.when(in_region, F.col(value))).alias("_r"), F.avg(value).alias("_w"), F.bool_or(focal).alias("focal"))
    few = F.col("n_region") < min_residues
    return n.select(member, "focal", "n_region", F.when(~few, F.col("_r") - F.col("_w")).alias("delta"), F.when(few, F.lit("too few residues")).alias("skipped"))
