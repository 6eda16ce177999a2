"""Pseudogene evidence over documents as genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import evidence as E
from cladeframe.operators import sets as S
from cladeframe.plans.catalog import query
from cladeframe.plans.views import GENES, genes, placed, t
from cladeframe.stage import staged

MARK = "."
def share():
    return F.length(F.regexp_replace(F.col("seq"), "[^aeiou]", "")).cast("double") / F.length("seq")

SCANS = f"""{GENES},
stops AS (SELECT gene, length(rtrim(seq, '.')) - length(replace(rtrim(seq, '.'), '.', '')) AS internal_stops FROM g),
med AS (SELECT family, median(length(seq)) AS m FROM g GROUP BY family),
trunc AS (SELECT gene FROM g JOIN med USING (family) WHERE length(seq) < CAST(0.5 AS DOUBLE) * m),
orph AS (SELECT gene FROM g WHERE gene NOT IN (SELECT gene FROM placed)),
share AS (SELECT gene, species, CAST(length(regexp_replace(seq, '[^aeiou]', '', 'g')) AS DOUBLE) / length(seq) AS x FROM g WHERE length(seq) > 0),
comp AS (SELECT species, avg(x) AS mu, stddev_samp(x) AS sd, count(*) AS n FROM share GROUP BY species),
zs AS (SELECT gene, (x - mu) / sd AS z FROM share JOIN comp USING (species) WHERE n >= 20 AND sd > 0 AND abs((x - mu) / sd) > 3),
ev AS (SELECT g.gene, g.species, g.family, CASE WHEN coalesce(internal_stops, 0) > 0 THEN internal_stops ELSE 0 END AS internal_stops,
  t.gene IS NOT NULL AS truncated, o.gene IS NOT NULL AS orphan, z.z AS zscore
  FROM g LEFT JOIN stops s ON g.gene = s.gene LEFT JOIN trunc t ON g.gene = t.gene LEFT JOIN orph o ON g.gene = o.gene LEFT JOIN zs z ON g.gene = z.gene
  WHERE coalesce(internal_stops, 0) > 0 OR t.gene IS NOT NULL OR o.gene IS NOT NULL OR z.z IS NOT NULL),
scored AS (SELECT *, least(CASE WHEN internal_stops > 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN truncated THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN orphan THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN zscore IS NOT NULL THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(1 AS DOUBLE)) AS score FROM ev),
classed AS (SELECT *, CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 'pseudogene_high' WHEN score >= CAST(0.25 AS DOUBLE) THEN 'pseudogene_medium' WHEN score > 0 THEN 'pseudogene_low' ELSE 'functional' END AS class FROM scored)"""


def evidence(spark, sf_dir):
    """The texts are read once: what the scanners need of them is a few numbers a gene."""
    g = genes(spark, sf_dir)
    narrow = staged(g.select("gene", "species", "family", E.inner_count(F.col("seq"), MARK).alias("internal_stops"), F.length("seq").alias("length"), F.when(F.length("seq") > 0, share()).alias("share")), "evidence")
    scans = [
        narrow.where("internal_stops > 0").select("gene", "internal_stops"),
        E.truncated(narrow, "gene", "family", "length"),
        E.orphan_genes(narrow, placed(spark, sf_dir), "gene"),
        E.composition_outliers(narrow, "gene", "species", "share"),
    ]
    merged = E.with_score(E.merge(scans, "gene"))
    return merged.join(narrow.select("gene", "species", "family"), "gene")


@query(f"WITH {SCANS} SELECT gene, species, family, internal_stops, truncated, orphan, round(zscore, 6) AS zscore, round(score, 6) AS score, class FROM classed")
def pseudo_evidence_report(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return e.select("gene", "species", "family", "internal_stops", "truncated", "orphan", F.round("zscore", 6).alias("zscore"), F.round("score", 6).alias("score"), "class")


@query(f"WITH {GENES} SELECT gene, length(rtrim(seq, '.')) - length(replace(rtrim(seq, '.'), '.', '')) AS internal_stops FROM g WHERE length(rtrim(seq, '.')) - length(replace(rtrim(seq, '.'), '.', '')) > 0")
def scan_char_count(spark, sf_dir):
    return E.internal_stops(genes(spark, sf_dir), "gene", "seq", MARK)


@query(
    f"""WITH {GENES}, p AS (SELECT gene, len(string_split_regex(trim(seq), '\\s+')) AS words, n_chars FROM g WHERE length(trim(seq)) > 0)
SELECT gene, round(n_chars / (CAST(6 AS DOUBLE) * words), 6) AS length_ratio, CASE WHEN n_chars / (CAST(6 AS DOUBLE) * words) < 1 THEN 'cds_short' ELSE 'cds_long' END AS note
FROM p WHERE words > 0 AND abs(n_chars / (CAST(6 AS DOUBLE) * words) - 1) > CAST(0.1 AS DOUBLE)"""
)
def length_discrepancy(spark, sf_dir):
    g = genes(spark, sf_dir)
    left = g.where(F.length(F.trim("seq")) > 0).select("gene", F.size(F.split(F.trim("seq"), r"\s+")).alias("words"))
    out = E.length_discrepancies(left, g.select("gene", "n_chars"), "gene", "words", "n_chars", per=6.0)
    return out.select("gene", F.round("length_ratio", 6).alias("length_ratio"), F.get("notes", F.lit(0)).alias("note"))


@query(f"WITH {SCANS} SELECT gene FROM trunc")
def truncated_vs_family_median(spark, sf_dir):
    g = genes(spark, sf_dir).withColumn("length", F.length("seq"))
    return E.truncated(g, "gene", "family", "length").select("gene")


@query(f"WITH {SCANS} SELECT gene FROM orph")
def orphan_anti_join(spark, sf_dir):
    return E.orphan_genes(genes(spark, sf_dir), placed(spark, sf_dir), "gene").select("gene")


@query(f"WITH {SCANS} SELECT gene, round(z, 6) AS zscore FROM zs")
def composition_zscore(spark, sf_dir):
    g = genes(spark, sf_dir).where(F.length("seq") > 0).withColumn("share", share())
    return E.composition_outliers(g, "gene", "species", "share").select("gene", F.round("zscore", 6).alias("zscore"))


@query(
    """WITH l AS (SELECT s_nationkey AS tree, s_suppkey AS gene, s_acctbal + 1000 AS d FROM supplier), m AS (SELECT tree, median(d) AS m, count(*) AS n FROM l GROUP BY tree)
SELECT gene, round(d / m, 6) AS distance_ratio FROM l JOIN m USING (tree) WHERE n >= 3 AND m > 0 AND d / m > CAST(1.5 AS DOUBLE)"""
)
def distance_outliers(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tree"), F.col("s_suppkey").alias("gene"), (F.col("s_acctbal") + 1000).alias("d"))
    return E.distance_outliers(s, "tree", "gene", "d", ratio=1.5).select("gene", F.round("distance_ratio", 6).alias("distance_ratio"))


@query(
    f"""WITH {SCANS}, m AS (SELECT g.family, g.species, count(*) AS n, count(*) FILTER (c.class <> 'functional') AS p, sum(c.score) FILTER (c.class <> 'functional') AS s
  FROM g LEFT JOIN classed c ON g.gene = c.gene GROUP BY 1, 2)
SELECT family, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(p) AS BIGINT) AS n_pseudo, round(CAST(sum(p) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS fraction, round(sum(s) / CAST(sum(p) AS DOUBLE), 6) AS mean_score,
  string_agg(species || ':' || p || '/' || n, ',' ORDER BY species) FILTER (p > 0) AS by_species, count(*) FILTER (p > 0) AS n_species
FROM m GROUP BY family HAVING sum(p) > 0"""
)
def family_enrichment(spark, sf_dir):
    e = evidence(spark, sf_dir).select("gene", "score", "class")
    out = E.family_report(genes(spark, sf_dir), e, "gene", "family", "species")
    return out.withColumns({"fraction": F.round("fraction", 6), "mean_score": F.round("mean_score", 6)})


@query(
    f"""WITH {SCANS} SELECT g.species, count(*) AS n_total, count(p.gene) AS n_placed, count(*) FILTER (p.gene IS NULL) AS n_orphan, count(*) FILTER (class = 'pseudogene_high') AS n_high,
  count(*) FILTER (class = 'pseudogene_medium') AS n_medium, count(*) FILTER (class = 'pseudogene_low') AS n_low, count(*) FILTER (class <> 'functional') AS n_pseudo,
  round(coalesce(avg(score) FILTER (class <> 'functional'), 0), 6) AS mean_score, round(CAST(count(*) FILTER (class <> 'functional') AS DOUBLE) / count(*), 6) AS rate
FROM g LEFT JOIN placed p ON g.gene = p.gene LEFT JOIN classed c ON g.gene = c.gene GROUP BY g.species"""
)
def species_comparison(spark, sf_dir):
    e = evidence(spark, sf_dir).select("gene", "score", "class")
    out = E.species_report(genes(spark, sf_dir), placed(spark, sf_dir), e, "gene", "species")
    return out.withColumns({"mean_score": F.round("mean_score", 6), "rate": F.round("rate", 6)})


@query(
    f"""WITH {SCANS}, x AS (SELECT 'class' AS level, class AS name FROM classed WHERE class <> 'functional' UNION ALL SELECT 'species', species FROM classed WHERE class <> 'functional'
  UNION ALL SELECT 'evidence', 'internal_stops' FROM classed WHERE internal_stops > 0 AND class <> 'functional' UNION ALL SELECT 'evidence', 'truncated' FROM classed WHERE truncated
  UNION ALL SELECT 'evidence', 'orphan' FROM classed WHERE orphan UNION ALL SELECT 'evidence', 'zscore' FROM classed WHERE zscore IS NOT NULL)
SELECT level, name, count(*) AS n FROM x GROUP BY 1, 2"""
)
def evidence_counts(spark, sf_dir):
    return E.counts(evidence(spark, sf_dir), "species")


@query(
    """WITH p AS (SELECT page_id AS gene, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, contains(html, '%%%') AS odd FROM pages)
SELECT host, count(*) AS n_total, count(*) FILTER (odd) AS n_pseudo, count(*) FILTER (odd) AS n_high, round(CAST(count(*) FILTER (odd) AS DOUBLE) / count(*), 6) AS rate FROM p GROUP BY host"""
)
def chrom_distribution(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select(F.col("page_id").alias("gene"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.contains("html", F.lit("%%%")).alias("odd"))
    e = p.select("gene", F.when(F.col("odd"), "pseudogene_high").otherwise("functional").alias("class"))
    return E.location_report(p, e, "gene", "host").withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH {SCANS} SELECT species || '_unknown' AS chrom, CAST(0 AS BIGINT) AS start, CAST(1000 AS BIGINT) AS "end", gene AS name, CAST(floor(score * 1000) AS BIGINT) AS score,
  CASE class WHEN 'pseudogene_high' THEN '255,0,0' WHEN 'pseudogene_medium' THEN '255,165,0' ELSE '255,255,0' END AS rgb FROM classed WHERE class <> 'functional'"""
)
def evidence_bed(spark, sf_dir):
    return E.bed(evidence(spark, sf_dir), "gene", "species").select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name", "score", "rgb")


@query(
    """WITH pool AS (SELECT o_orderkey AS gene, c_nationkey AS species FROM orders JOIN customer ON o_custkey = c_custkey),
lost AS (SELECT * FROM pool WHERE gene NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND gene NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > CAST(0.08 AS DOUBLE)))
SELECT species, count(*) AS n_lost FROM lost GROUP BY species"""
)
def conservation_audit(spark, sf_dir):
    o, c, li = (t(spark, sf_dir, x) for x in ("orders", "customer", "lineitem"))
    pool = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("gene"), F.col("c_nationkey").alias("species"))
    kept = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("gene"))
    recycled = li.where(F.col("l_discount") > 0.08).select(F.col("l_orderkey").alias("gene"))
    return S.conservation_audit(pool, kept, recycled, "gene").groupBy("species").agg(F.count("*").alias("n_lost"))


@query(
    """WITH a AS (SELECT doc_id, source AS grp FROM documents), b AS (SELECT DISTINCT l.doc_id, d.source AS grp FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality = 1),
f AS (SELECT coalesce(a.grp, b.grp) AS grp, a.doc_id AS x, b.doc_id AS y FROM (SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) a FULL OUTER JOIN b ON a.doc_id = b.doc_id)
SELECT grp, count(x) AS n_left, count(y) AS n_right, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_shared,
  round(CASE WHEN count(x) > 0 THEN CAST(100 AS DOUBLE) * count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(x) ELSE 0 END, 6) AS pct_shared FROM f GROUP BY grp"""
)
def id_agreement_full_outer(spark, sf_dir):
    d, lab = t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp")), t(spark, sf_dir, "labels")
    left = d.join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    right = lab.where("quality = 1").select("doc_id").join(d, "doc_id")
    return S.id_agreement(left, right, "doc_id", "grp").withColumn("pct_shared", F.round("pct_shared", 6))


@query(f"WITH {GENES} SELECT CASE WHEN species IN ('fr', 'xx') THEN 'excluded' ELSE 'kept' END AS part, count(*) AS n FROM g GROUP BY 1")
def exclude_partition(spark, sf_dir):
    kept, out, _ = S.partition_excluded(genes(spark, sf_dir), "species", ["fr", "xx"])
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(kept, "kept").union(count(out, "excluded"))
