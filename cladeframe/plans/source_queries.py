"""Formats of sequences, hits, groups and annotations: written from the driver's tables as their tools write them, and read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cladeframe.functions import exprs as X
from cladeframe.functions.ids import species_of
from cladeframe.operators import construct as N
from cladeframe.operators import selection as L
from cladeframe.plans.catalog import query
from cladeframe.plans.views import GENES, HITS, genes, hits, t
from cladeframe.sources import reports as K
from cladeframe.sources import text as S
from cladeframe.stage import shared_dir


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark, name, value, head=None):
    """The folder of a text table of these lines; head comes first in it."""
    path = _folder(spark, name)
    body = value.toDF("value")
    rows = body if head is None else spark.createDataFrame([(head,)], "value string").coalesce(1).unionByName(body)
    rows.write.text(path)
    return path


def _joined(sep, *columns):
    return F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


LETTERS = "[^A-Za-z]"


@query(f"WITH {GENES}, c AS (SELECT gene, upper(regexp_replace(seq, '{LETTERS}', '', 'g')) AS seq FROM g) SELECT gene AS id, CAST(length(seq) AS BIGINT) AS length, md5(seq) AS digest FROM c")
def fasta_read_back(spark, sf_dir):
    """Documents as proteins of one line of letters each, wrapped when written."""
    path = _folder(spark, "fasta")
    g = genes(spark, sf_dir)
    K.write_fasta(g.select(F.col("gene").alias("id"), F.upper(F.regexp_replace("seq", LETTERS, "")).alias("seq")), path)
    back = S.fasta(spark, path)
    sized = S.sequence_lengths(back)
    return back.select("id", F.md5(F.col("seq").cast("binary")).alias("digest")).join(sized, "id").select("id", "length", "digest")


@query(f"WITH {GENES} SELECT species, count(*) AS n, CAST(sum(length(regexp_replace(seq, '{LETTERS}', '', 'g'))) AS BIGINT) AS residues FROM g GROUP BY 1")
def fasta_by_species(spark, sf_dir):
    """One folder of sequences per species, read back over all of them."""
    path = _folder(spark, "species")
    K.split_by_species(genes(spark, sf_dir).select("species", F.col("gene").alias("id"), F.regexp_replace("seq", LETTERS, "").alias("seq")), path)
    back = S.fasta(spark, f"{path}/*").withColumn("species", F.regexp_extract("at.file", "species=([^/]*)", 1))
    return back.where(species_of(F.col("id")) == F.col("species")).groupBy("species").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("residues"))


@query(
    """WITH d AS (SELECT l_orderkey AS gene, l_suppkey AS family, l_linenumber * 10 AS hf, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS ht, l_linenumber * 20 AS af, CAST(l_linenumber * 20 + l_quantity AS BIGINT) AS at_ FROM lineitem),
h AS (SELECT gene, family, count(DISTINCT p) AS n FROM (SELECT gene, family, unnest(generate_series(hf, ht)) AS p FROM d) GROUP BY 1, 2), a AS (SELECT gene, family, count(DISTINCT p) AS n FROM (SELECT gene, family, unnest(generate_series(af, at_)) AS p FROM d) GROUP BY 1, 2),
k AS (SELECT gene, family, count(*) AS n_domains FROM d GROUP BY 1, 2)
SELECT CAST(k.gene AS VARCHAR) AS gene, CAST(k.family AS VARCHAR) AS family, n_domains, round(h.n / CAST(150 AS DOUBLE), 6) AS profile_cov, round(a.n / CAST(300 AS DOUBLE), 6) AS query_cov, round((k.gene % 500 + 10) / CAST(150 AS DOUBLE), 6) AS nbits
FROM k JOIN h ON k.gene = h.gene AND k.family = h.family JOIN a ON k.gene = a.gene AND k.family = a.family"""
)
def domains_read_back(spark, sf_dir):
    """Line items as domains of profile hits: coverage of profile and query by the union of a hit's domains."""
    li = t(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    lo, lo2 = F.col("l_linenumber") * 10, F.col("l_linenumber") * 20
    dash = F.lit("-")
    row = _joined(" ", "l_orderkey", dash, F.lit(300), "l_suppkey", dash, F.lit(150), F.lit("1e-30"), F.col("l_orderkey") % 500 + 10, F.lit("0.1"), F.lit("1 1 1e-9 1e-9"), F.lit("20.5"), F.lit("0.0"), lo, lo + q, lo2, lo2 + q, F.lit("1 90 0.9 some text"))
    path = _lines(spark, "domtbl", li.select(row), "# target name")
    out = S.profile_hits(S.domtblout(spark, path))
    return out.select("gene", "family", F.size("domains").cast("long").alias("n_domains"), *[F.round(c, 6).alias(c) for c in ("profile_cov", "query_cov", "nbits")])


@query("SELECT CAST(gene AS VARCHAR) AS gene, CAST(family AS VARCHAR) AS family FROM (SELECT l_orderkey AS gene, l_suppkey AS family, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_extendedprice * 100)) AS rn FROM lineitem WHERE round(l_extendedprice * 100) <= 9000000) WHERE rn = 1")
def profile_table_read_back(spark, sf_dir):
    """The hit of least E-value of each gene, up to a bound."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = t(spark, sf_dir, "lineitem").select(_joined(" ", "l_orderkey", F.lit("-"), "l_suppkey", F.lit("-"), F.concat(cents.cast("string"), F.lit("e-12"))))
    return S.tblout(spark, _lines(spark, "tbl", rows, "# hits"), 9e-6).select("gene", "family")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS gene, 'R1_OG' || l_suppkey AS family, round(max(round(l_extendedprice * 100)) / CAST(11000000 AS DOUBLE), 6) AS tm FROM lineitem GROUP BY 1, 2")
def structure_hits_read_back(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = t(spark, sf_dir, "lineitem").select(_joined("\t", "l_orderkey", F.concat(F.lit("R1_OG"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".pdb").otherwise(".cif.gz")), F.lit("1e-9"), F.lit("100"), cents / F.lit(11000000.0)))
    return S.foldseek(spark, _lines(spark, "foldseek", rows)).select("gene", "family", F.round("tm", 6).alias("tm"))


@query(
    """SELECT CAST(q AS VARCHAR) AS qseqid, sp AS species, s AS sseqid, CAST(b AS DOUBLE) AS bitscore FROM (SELECT l_orderkey AS q, CAST(s_nationkey AS VARCHAR) AS sp, s_nationkey || '_' || l_suppkey || '_' || l_linenumber AS s, CAST(round(l_extendedprice * 100) AS BIGINT) AS b,
  row_number() OVER (PARTITION BY l_orderkey, s_nationkey ORDER BY round(l_extendedprice * 100) DESC) AS rn FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE rn = 1"""
)
def best_hits_by_species_read_back(spark, sf_dir):
    """A twelve-column hit table: each query's best hit in each species."""
    li, s = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "supplier")
    met = li.join(s, li.l_suppkey == s.s_suppkey)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = met.select(_joined("\t", "l_orderkey", _joined("_", "s_nationkey", "l_suppkey", "l_linenumber"), F.lit("90\t100\t0\t0\t1\t10\t1\t10\t1e-9"), cents))
    return S.blast_best(spark, _lines(spark, "blast", rows), species_of(F.col("sseqid")).alias("species")).select("qseqid", "species", "sseqid", "bitscore")


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene, CASE WHEN p_size % 3 = 0 THEN '' ELSE '1.' || p_size || '.1.1' END AS ec, p_size % 3 <> 0 AS is_enzyme, p_name AS name FROM part")
def annotations_read_back(spark, sf_dir):
    """An annotation table found by its header, of which the first of several EC numbers counts."""
    ec = F.when(F.col("p_size") % 3 == 0, "-").otherwise(F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".1.1,9.9.9.9")))
    rows = t(spark, sf_dir, "part").select(_joined("\t", "p_partkey", ec, "p_name"))
    return S.emapper(spark, _lines(spark, "emapper", rows, "#query\tEC\tPreferred_name")).select("gene", "ec", "is_enzyme", F.col("Preferred_name").alias("name"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene, CASE WHEN p_size > 25 THEN '2.2.2.' || p_size ELSE '1.1.1.' || p_size END AS ec, CASE WHEN p_size > 25 THEN p_size / CAST(100 AS DOUBLE) ELSE CAST(0.255 AS DOUBLE) END AS confidence FROM part")
def enzyme_candidates_read_back(spark, sf_dir):
    """Of several candidates with confidences, the surest."""
    size = F.col("p_size").cast("string")
    cand = F.concat(F.lit("EC:1.1.1."), size, F.lit("/0.255;EC:2.2.2."), size, F.lit("/"), (F.col("p_size") / 100).cast("string"))
    return S.clean(spark, _lines(spark, "clean", t(spark, sf_dir, "part").select(_joined(",", "p_partkey", cand))))


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene, p_size % 4 <> 0 AS is_enzyme, CASE WHEN p_size % 4 = 0 THEN '' ELSE '3.1.' || p_size || '.2' END AS ec, CASE WHEN p_size % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE p_size / CAST(64 AS DOUBLE) END AS confidence FROM part")
def enzyme_table_read_back(spark, sf_dir):
    """A table whose columns go by other names, with empty and unreadable cells."""
    path = _folder(spark, "enzymes")
    ec = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("3.1."), F.col("p_size").cast("string"), F.lit(".2")))
    score = F.when(F.col("p_size") % 5 == 0, "n/a").otherwise((F.col("p_size") / 64).cast("string"))
    t(spark, sf_dir, "part").select(F.col("p_partkey").alias("Protein_ID"), ec.alias("EC_Number"), score.alias("Score")).write.option("header", True).csv(path)
    return S.enzymes(spark, path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS gene, CASE WHEN (s_nationkey + 1) / CAST(26 AS DOUBLE) >= CAST(0.5 AS DOUBLE) THEN 'Plastid' WHEN 1 - (s_nationkey + 1) / CAST(26 AS DOUBLE) >= CAST(0.5 AS DOUBLE) THEN 'Cytoplasm' END AS location FROM supplier")
def locations_read_back(spark, sf_dir):
    """Classes and their probabilities; the surest class, if it is sure enough."""
    path = _folder(spark, "locations")
    p = (F.col("s_nationkey") + 1) / F.lit(26.0)
    t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("Protein_ID"), F.lit("").alias("Localizations"), F.lit("none").alias("Signals"), p.alias("Plastid"), (1 - p).alias("Cytoplasm"), F.lit("x").alias("Note")).write.option("header", True).csv(path)
    return S.localization(spark, path).select("gene", X.top_location(F.col("label"), F.col("probs"), 0.5).alias("location"))


@query("SELECT 'N' || s_nationkey AS og, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS species, 's' || s_suppkey AS gene FROM supplier")
def orthogroups_read_back(spark, sf_dir):
    """A wide table of groups: a row a group, a column a species, lists of genes in its cells."""
    s = t(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("og"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("species"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene"))
    wide = K.wide_groups(s, "og", "species", "gene", ["even", "odd"])
    return S.orthogroups(spark, _lines(spark, "orthogroups", wide.select(F.concat_ws("\t", "og", "even", "odd")), "Orthogroup\teven\todd"))


@query("SELECT 'N' || s_nationkey AS family_id, 's' || s_suppkey AS gene FROM supplier")
def summary_read_back(spark, sf_dir):
    """The summary of families, written as a table for people, gives their members again."""
    s = t(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("family_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene"), (F.col("s_suppkey") % 3).alias("species"))
    path = _folder(spark, "summary")
    K.tsv(K.summary(s, "family_id", "gene", "species"), path)
    return S.summary_members(spark, path)


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer")
def pairs_read_back(spark, sf_dir):
    """Two columns without a header; transcripts' numbers are taken off their names."""
    rows = t(spark, sf_dir, "customer").select(_joined("\t", F.concat(F.col("c_name"), F.lit(".2")), "c_mktsegment"))
    return S.two_columns(spark, _lines(spark, "pairs", rows, "# gene\tvalue"), strip=True)


@query("SELECT CAST(vec_id AS VARCHAR) AS gene, CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last FROM embeddings")
def embeddings_read_back(spark, sf_dir):
    path = _folder(spark, "vectors")
    K.write_embeddings(t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("gene"), "embedding"), path)
    back = S.embeddings(spark, path)
    return back.select("gene", F.size("embedding").alias("n"), F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.element_at("embedding", -1), 6).alias("last"))


@query(
    """SELECT l_returnflag AS contig, CAST(round(l_extendedprice) AS INTEGER) AS start, CAST(round(l_extendedprice) + l_quantity AS INTEGER) AS end_, round(l_discount + CAST(0.9 AS DOUBLE), 2) AS identity, CASE WHEN l_discount < CAST(0.045 AS DOUBLE) THEN 'identity' WHEN l_quantity < 20 THEN 'length' ELSE 'ok' END AS status, count(*) AS n
FROM lineitem GROUP BY ALL"""
)
def gene_models_read_back(spark, sf_dir):
    """Predicted models with the protein on the line before each, and why they are refused."""
    start = F.round("l_extendedprice").cast("long")
    model = F.concat_ws("\t", F.col("l_returnflag"), F.lit("miniprot\tmRNA"), start.cast("string"), (start + F.col("l_quantity").cast("long")).cast("string"), F.lit(".\t+\t."), F.concat(F.lit("ID=x;Rank=1;Identity="), F.round(F.col("l_discount") + 0.9, 2).cast("string"), F.lit(";Target=anchor 1 9")))
    protein = F.concat(F.lit("##STA\t"), F.repeat(F.lit("M"), F.col("l_quantity").cast("int")), F.lit("*\n"))
    found = S.miniprot(spark, _lines(spark, "models", t(spark, sf_dir, "lineitem").select(F.concat(protein, model))))
    status = L.acceptance(F.col("identity"), F.col("protein"), min_identity=0.945, min_length=20)
    return found.groupBy("contig", "start", F.col("end").alias("end_"), "identity", status.alias("status")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {HITS}, ok AS (SELECT gene, family, gate / 10000 AS evalue, bits FROM h JOIN supplier ON family = s_suppkey JOIN orders ON gene = o_orderkey WHERE s_nationkey <> 3 AND o_orderstatus = 'O' AND gate / 10000 < CAST(0.00001 AS DOUBLE))
SELECT gene, family, round(evalue * 1000000, 4) AS micro_evalue, bits FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY evalue, bits DESC, family) AS rn FROM ok) WHERE rn = 1"""
)
def rescued_genes(spark, sf_dir):
    """Open orders as unplaced genes: the family of each one's best profile hit within the bound, among families there are."""
    h = hits(spark, sf_dir).select("gene", "family", (F.col("gate") / 10000).alias("evalue"), "bits")
    open_ = t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("gene"))
    families = t(spark, sf_dir, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").alias("family"))
    return N.rescued(open_, h, families).select("gene", "family", F.round(F.col("evalue") * 1000000, 4).alias("micro_evalue"), "bits")


@query(
    f"""WITH {HITS}, a AS (SELECT gene, family AS edge FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY bits DESC, family) AS rn FROM h) WHERE rn = 1),
c AS (SELECT DISTINCT gene, s_nationkey AS family FROM h JOIN supplier ON family = s_suppkey WHERE gate <= CAST(0.04 AS DOUBLE))
SELECT o_orderkey AS gene, c.family FROM orders LEFT JOIN a ON o_orderkey = a.gene AND CAST(o_totalprice / 1000 AS BIGINT) >= 150 LEFT JOIN supplier ON a.edge = s_suppkey LEFT JOIN c ON c.gene = o_orderkey AND c.family = s_nationkey"""
)
def adjudicated_genes(spark, sf_dir):
    """Orders as genes: the candidate nation that the supplier (edge) of each one's best hit says, for orders of enough length."""
    h = hits(spark, sf_dir)
    s = t(spark, sf_dir, "supplier")
    length = F.round(F.col("o_totalprice") / 1000).cast("long")
    g = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gene"), length.alias("length"))
    nation = s.select(F.col("s_suppkey").alias("family"), F.col("s_nationkey").alias("clan"))
    candidates = h.where(F.col("gate") <= 0.04).join(nation, "family").select("gene", F.col("clan").alias("family"))
    best = h.groupBy("gene").agg(F.min_by("family", F.struct(-F.col("bits"), F.col("family"))).alias("edge_num")).withColumn("reference", F.lit("all"))
    edges = nation.select(F.lit("all").alias("reference"), F.col("family").alias("edge_num"), F.col("clan").alias("family"))
    return N.adjudicated(g, candidates, best, edges)
