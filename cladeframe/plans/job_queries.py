"""The jobs as queries: each runs twice into one new folder of the shared one, over the whole tables, and is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cladeframe.plans.catalog import query
from cladeframe.stage import shared_dir
from jobs import grow_families as G
from jobs import screen_sequences as Q
from jobs.common import settings


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """WITH g AS (SELECT concat_ws('_', coalesce(nullif(lang, ''), 'unknown'), CAST(doc_id AS VARCHAR)) AS gene, coalesce(nullif(lang, ''), 'unknown') AS species, coalesce(nullif(source, ''), 'unknown') AS family, coalesce(text, '') AS seq FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT gene, species, family, seq, length(seq) AS length, length(rtrim(seq, '.')) - length(replace(rtrim(seq, '.'), '.', '')) AS internal_stops, CASE WHEN length(seq) > 0 THEN CAST(length(regexp_replace(seq, '[^aeiou]', '', 'g')) AS DOUBLE) / length(seq) END AS share FROM g),
med AS (SELECT family, median(length) AS m FROM n GROUP BY family),
comp AS (SELECT family, avg(share) AS mu, stddev_samp(share) AS sd FROM n WHERE share IS NOT NULL GROUP BY family HAVING count(*) >= 20),
cp AS (SELECT family, seq, min(gene) AS first FROM n WHERE length > 0 GROUP BY family, seq),
e AS (SELECT n.*, length < CAST(0.5 AS DOUBLE) * m AS truncated, CASE WHEN sd > 0 AND abs((share - mu) / sd) > 3 THEN (share - mu) / sd END AS zscore, CASE WHEN gene <> first THEN first END AS copy_of
  FROM n JOIN med ON n.family = med.family LEFT JOIN comp ON n.family = comp.family LEFT JOIN cp ON n.family = cp.family AND n.seq = cp.seq),
s AS (SELECT *, CASE WHEN internal_stops > 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN truncated THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN zscore IS NOT NULL THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM e)
SELECT gene, species, family, length, internal_stops, truncated, round(zscore, 6) AS zscore, copy_of, round(score, 6) AS score,
  CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 'pseudogene_high' WHEN score >= CAST(0.25 AS DOUBLE) THEN 'pseudogene_medium' WHEN score > 0 THEN 'pseudogene_low' ELSE 'functional' END AS class FROM s"""
)
def job1_screen_sequences(spark, sf_dir):
    """Incremental screening of all documents as sequences of their source's family."""
    folder, c = _folder(spark, "job1"), settings(Q.Screening, None, "screen_sequences.json")
    for _ in range(2):
        out = Q.run(spark, f"{sf_dir}/documents*.parquet", f"{folder}/out", f"{folder}/checkpoint", c)
    return out.select("gene", "species", "family", "length", "internal_stops", "truncated", F.round("zscore", 6).alias("zscore"), "copy_of", F.round("score", 6).alias("score"), "class")


@query(
    """WITH RECURSIVE h AS (SELECT DISTINCT l_orderkey AS gene, l_partkey AS profile FROM lineitem WHERE l_quantity >= 45),
s AS (SELECT l_orderkey AS gene, min(CAST(l_suppkey AS VARCHAR)) AS family FROM lineitem WHERE l_extendedprice >= 104000 GROUP BY 1),
r(gene, family, round) USING KEY (gene) AS (SELECT gene, family, 0 FROM s UNION
  SELECT b.gene, min(r.family), max(r.round) + 1 FROM r JOIN h a ON r.gene = a.gene JOIN h b ON a.profile = b.profile WHERE b.gene NOT IN (SELECT gene FROM recurring.r) GROUP BY b.gene)
SELECT CAST(g.gene AS VARCHAR) AS gene, family, CAST(round AS INTEGER) AS round, CASE WHEN family IS NOT NULL THEN 'placed' WHEN linked THEN 'open' ELSE 'unlinked' END AS status
FROM (SELECT l_orderkey AS gene, bool_or(l_quantity >= 45) AS linked FROM lineitem GROUP BY 1) g LEFT JOIN r ON g.gene = r.gene"""
)
def job2_grow_families(spark, sf_dir):
    """Families grown over line items as hits: orders are genes, parts profiles, suppliers the families of sure hits."""
    folder, c = _folder(spark, "job2"), settings(G.Growing, None, "grow_families.json")
    for _ in range(2):
        out = G.run(spark, f"{sf_dir}/lineitem.parquet", folder, c)
    return out
