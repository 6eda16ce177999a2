"""Command line: python -m cladeframe.cli <job> ... Each job reads tables or tool outputs and writes one table."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.config import Settings
from cladeframe.functions.ids import species_of
from cladeframe.operators import columns as C
from cladeframe.operators import evidence as E
from cladeframe.operators import selection as L
from cladeframe.operators import sets as S
from cladeframe.operators import stats as T
from cladeframe.operators import topk as K
from cladeframe.operators import trees as R
from cladeframe.operators import votes as V
from cladeframe.session import session
from cladeframe.sources import reports
from cladeframe.sources import text as X
from cladeframe.sources import tools

Args = argparse.Namespace


def _genes(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "gene").withColumn("species", species_of(F.col("gene")))


def pseudogenes(spark: SparkSession, a: Args) -> DataFrame:
    proteins, cds = _genes(X.fasta_dir(spark, a.proteins)), _genes(X.fasta_dir(spark, a.cds)).select("gene", F.col("seq").alias("cds"))
    members = X.summary_members(spark, a.summary).withColumnRenamed("family_id", "family")
    sized = proteins.withColumn("length", F.length("seq"))
    shares = cds.withColumn("species", species_of(F.col("gene"))).select("gene", "species", *E.composition(F.col("cds")))
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    scans = [
        E.internal_stops(proteins, "gene", "seq"),
        E.length_discrepancies(proteins.select("gene", F.length(F.rtrim("seq", F.lit("*"))).alias("p")), cds.select("gene", F.length(bare(F.col("cds"))).alias("c")), "gene", "p", "c"),
        E.truncated(sized.join(members, "gene"), "gene", "family", "length"),
        E.orphan_genes(proteins, members, "gene"),
        E.composition_outliers(shares, "gene", "species", "gc3"),
    ]
    return E.ranked(E.with_score(E.merge(scans, "gene")), "gene")


def assign(spark: SparkSession, a: Args) -> DataFrame:
    s = a.settings
    hits = X.profile_hits(X.domtblout(spark, a.hits))
    gate = (F.col("evalue") <= s.max_evalue) & (F.col("profile_cov") >= s.min_profile_cov) & (F.col("query_cov") >= s.min_query_cov)
    return K.with_margin(hits, "gene", "family", "bits", gate, F.greatest(F.lit(s.margin_bits), F.lit(s.margin_fraction) * F.col("bits")))


def structures(spark: SparkSession, a: Args) -> DataFrame:
    s = a.settings
    return K.with_margin(X.foldseek(spark, a.hits), "gene", "family", "tm", F.col("tm") >= s.min_tm, F.lit(s.tm_margin), strict=True)


def placements(spark: SparkSession, a: Args) -> DataFrame:
    s = a.settings
    return K.placement(X.jplace(spark, a.jplace), "gene", "edge_num", "like_weight_ratio", "pendant_length", s.min_lwr, s.lwr_margin, s.max_pendant)


def matrix(spark: SparkSession, a: Args) -> DataFrame:
    axes = [("emapper", X.emapper(spark, a.emapper).select("gene", "ec"))]
    if a.clean:
        axes.append(("clean", X.clean(spark, a.clean)))
    merged = S.axis_matrix(axes, "gene")
    ec = lambda n: F.nullif(F.col(n)["ec"], F.lit(""))
    sure = {n: ec(n) if n == "emapper" else F.when(F.col(n)["confidence"] >= a.settings.clean_conf, ec(n)) for n, _ in axes}
    return merged.select("gene", *S.verdict([(n, c == a.expected_ec) for n, c in sure.items()], [(n, c != a.expected_ec) for n, c in sure.items()]))


def names(spark: SparkSession, a: Args) -> DataFrame:
    members = X.summary_members(spark, a.summary)
    said = X.two_columns(spark, a.annotations).select(F.col("key").alias("gene"), F.col("value").alias("description"), F.lit("direct").alias("source"))
    sizes = members.groupBy("family_id").agg(F.countDistinct("gene").alias("size"))
    weights = {"direct": a.settings.weight_direct, "orthology": a.settings.weight_orthology}
    return V.weighted_names(members.join(said, "gene"), "family_id", "description", "source", weights, sizes)


def switches(spark: SparkSession, a: Args) -> DataFrame:
    trees = X.whole(spark, a.trees).select(F.col("file").alias("tree_id"), F.col("value").alias("newick"))
    states = X.two_columns(spark, a.states).select(F.col("key").alias("leaf"), F.col("value").alias("state"))
    leaves = R.N.tree_nodes(trees).where("is_leaf").select("tree_id", F.col("name").alias("leaf"))
    return R.switch_events(trees, leaves.join(states, "leaf"))


def unplaced(spark: SparkSession, a: Args) -> DataFrame:
    groups = X.orthogroups(spark, a.orthogroups, dedupe=False)
    n = groups.groupBy("og").agg(F.count("*").alias("n"), F.countDistinct("species").alias("k"))
    wanted = X.lines(spark, a.genes).select(F.trim("value").alias("gene"))
    obs = wanted.join(groups, "gene", "left").join(n, "og", "left").select("gene", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("k", F.lit(1)) - 1).alias("o"), F.lit(False).alias("h"))
    return T.unplaced_verdicts(obs, "gene", "n", "o", "h", a.settings.min_orthogroup_size)


def diagnostic(spark: SparkSession, a: Args) -> DataFrame:
    rows = X.fasta(spark, a.alignment).select(F.col("id").alias("seq_id"), F.col("seq").alias("aligned"))
    grp = X.two_columns(spark, a.groups).select(F.col("key").alias("seq_id"), F.col("value").alias("grp"))
    s = a.settings
    return C.diagnostic_columns(C.cells(rows.join(grp, "seq_id"), "seq_id", "aligned", "grp"), "grp", s.sdp_min_group, s.sdp_in_cons, s.sdp_out_max, s.min_cover)


def models(spark: SparkSession, a: Args) -> DataFrame:
    found = X.miniprot(spark, a.gff).withColumn("status", L.acceptance(F.col("identity"), F.col("protein")))
    return L.best_per_locus(found.where("status = 'ok'"), "contig", "start", "end", "identity")


def windows(spark: SparkSession, a: Args) -> DataFrame:
    w = spark.read.option("header", True).option("sep", "\t").csv(a.windows)
    w = w.withColumns({c: F.col(c).try_cast("int") for c in ("start", "end")})
    return S.interval_overlaps(X.beb_sites(spark, a.beb).select("site", "aa", "prob"), "site", w, "start", "end")


def orthology(spark: SparkSession, a: Args) -> DataFrame:
    forward = X.blast_best(spark, a.forward).select(F.col("qseqid").alias("gene"), F.col("sseqid").alias("target"), "evalue", "bitscore", species_of(F.col("qseqid")).alias("species"))
    back = X.blast_best(spark, a.reverse, species_of(F.col("sseqid")).alias("species")).select(F.col("qseqid").alias("target"), F.col("sseqid").alias("gene"), "species")
    return K.reciprocal_best(forward, back, "gene", "target", "species")


def transfer(spark: SparkSession, a: Args) -> DataFrame:
    from cladeframe.functions.ids import accession

    best = X.structure_best(spark, a.hits).withColumn("uniprot", accession(F.col("target")))
    known = spark.read.option("header", True).option("sep", "\t").csv(a.annotations)
    return reports.transfer(best, known, "uniprot")


def lengths(spark: SparkSession, a: Args) -> DataFrame:
    sized = X.sequence_lengths(X.fasta_dir(spark, a.proteins)).withColumn("species", species_of(F.col("id")))
    return T.short_fractions(sized, "species", "length", a.floor)


def supermatrix(spark: SparkSession, a: Args) -> DataFrame:
    rows = X.fasta(spark, a.alignments).select(F.col("at.file").alias("locus"), species_of(F.col("id")).alias("species"), F.col("seq").alias("aligned"))
    kept = C.drop_gap_codons(rows, "species", "aligned", "locus")
    return C.concatenated(kept, "locus", "seq_id", "aligned").withColumnRenamed("seq_id", "species")


def disorder(spark: SparkSession, a: Args) -> DataFrame:
    values = X.residue_plddt(spark, a.structures)
    focal = F.coalesce(F.col("file").rlike(a.focal), F.lit(False))
    lo, hi = map(int, a.region.split("-"))
    return C.region_contrast(values, "file", "residue", "value", F.col("residue").between(lo, hi), focal)


def plan(spark: SparkSession, a: Args) -> DataFrame:
    axes = tools.plan(a.fasta, a.folder, structures=a.structures, drop_unavailable=True)
    return spark.createDataFrame([(x.name, x.command, x.output) for x in axes], "name string, command string, output string")


JOBS = {
    "pseudogenes": (pseudogenes, ("proteins", "cds", "summary")),
    "assign": (assign, ("hits",)),
    "structures": (structures, ("hits",)),
    "placements": (placements, ("jplace",)),
    "matrix": (matrix, ("emapper", "expected-ec"), ("clean",)),
    "names": (names, ("summary", "annotations")),
    "switches": (switches, ("trees", "states")),
    "unplaced": (unplaced, ("orthogroups", "genes")),
    "diagnostic": (diagnostic, ("alignment", "groups")),
    "models": (models, ("gff",)),
    "windows": (windows, ("beb", "windows")),
    "orthology": (orthology, ("forward", "reverse")),
    "transfer": (transfer, ("hits", "annotations")),
    "lengths": (lengths, ("proteins",)),
    "supermatrix": (supermatrix, ("alignments",)),
    "disorder": (disorder, ("structures", "focal", "region")),
    "plan": (plan, ("fasta", "folder"), ("structures",)),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeframe", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    for name, (_, required, *optional) in JOBS.items():
        p = jobs.add_parser(name)
        p.add_argument("--out", required=True, help="folder of the resulting table (TSV)")
        p.add_argument("--settings", default=None, help="JSON of settings")
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for o in optional[0] if optional else ():
            p.add_argument(f"--{o}", default=None)
        if name == "lengths":
            p.add_argument("--floor", type=int, default=100)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.settings = Settings.from_json(a.settings) if a.settings else Settings()
    spark = spark or session(a.job)
    reports.tsv(JOBS[a.job][0](spark, a), a.out)


if __name__ == "__main__":
    main()
