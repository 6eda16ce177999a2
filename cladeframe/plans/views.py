"""Views of the driver's business tables in the roles that the operators ask for, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.stage import spread


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as genes: the language is the species, the source the family, the text the sequence."""
    d = t(spark, sf_dir, "documents")
    return d.select(F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("gene"), F.col("lang").alias("species"), F.col("source").alias("family"), F.col("text").alias("seq"), "doc_id", "n_chars")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as genes that are in a family."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    return t(spark, sf_dir, "labels").select("doc_id").distinct().join(d, "doc_id").select(F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("gene"))


GENES = """g AS (SELECT concat_ws('_', lang, CAST(doc_id AS VARCHAR)) AS gene, lang AS species, source AS family, text AS seq, doc_id, n_chars FROM documents),
placed AS (SELECT DISTINCT concat_ws('_', d.lang, CAST(d.doc_id AS VARCHAR)) AS gene FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as profile hits: orders are genes, suppliers families, the price the bits, the discount the gate."""
    li = t(spark, sf_dir, "lineitem")
    # Most hits have one line, so lines are dealt by gene as they are; what follows by gene needs no other shuffle.
    rows = li.select(F.col("l_orderkey").alias("gene"), F.col("l_suppkey").alias("family"), "l_extendedprice", "l_discount", "l_quantity")
    by = spread(rows, li.count(), "gene").groupBy("gene", "family")
    return by.agg(F.max("l_extendedprice").alias("bits"), F.min("l_discount").alias("gate"), F.max("l_quantity").alias("cover"))


HITS = """h AS (SELECT l_orderkey AS gene, l_suppkey AS family, max(l_extendedprice) AS bits, min(l_discount) AS gate, max(l_quantity) AS cover FROM lineitem GROUP BY 1, 2)"""


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of an alignment: nation, segment and name, padded with gaps; groups are segments."""
    c, n = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    aligned = F.concat(F.rpad("n_name", 10, "-"), F.rpad("c_mktsegment", 12, "-"), F.lpad(F.col("c_custkey").cast("string"), 9, "-"))
    return rows.select(F.col("c_custkey").alias("seq_id"), F.upper(aligned).alias("aligned"), F.col("c_mktsegment").alias("grp"), F.col("n_regionkey").cast("long").alias("clan"))


ALIGNMENT = """a AS (SELECT c_custkey AS seq_id, upper(concat(rpad(n_name, 10, '-'), rpad(c_mktsegment, 12, '-'), lpad(CAST(c_custkey AS VARCHAR), 9, '-'))) AS aligned,
  c_mktsegment AS grp, CAST(n_regionkey AS BIGINT) AS clan FROM customer JOIN nation ON c_nationkey = n_nationkey),
cells AS (SELECT seq_id, grp, clan, CAST(i AS BIGINT) AS col, substr(aligned, CAST(i AS BIGINT), 1) AS residue FROM a, range(1, 32) r(i))"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, regions, nations and suppliers as an adjacency list."""
    r, n, s = (t(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("root").alias("name"))
    regions = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("root").alias("parent"), F.col("r_name").alias("name"))
    nations = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"))
    leaves = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.col("s_name").alias("name"))
    return root.unionByName(regions).unionByName(nations).unionByName(leaves)


TREE = """tree AS (SELECT 'root' AS node, NULL AS parent, 'root' AS name
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
up AS (SELECT node, node AS anc FROM tree UNION ALL SELECT u.node, t.parent FROM up u JOIN tree t ON u.anc = t.node WHERE t.parent IS NOT NULL),
depths AS (SELECT node, count(*) - 1 AS depth FROM up GROUP BY node),
leaf AS (SELECT node, name FROM tree WHERE node LIKE 's%' OR node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)),
closure AS (SELECT u.anc, d.depth AS anc_depth, l.name AS leaf FROM up u JOIN leaf l ON u.node = l.node JOIN depths d ON u.anc = d.node)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as votes: of the customer's nation, for a priority, from a source that the order's status says."""
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("grp"), F.col("o_orderpriority").alias("description"), F.when(F.col("o_orderstatus") == "F", "direct").otherwise("orthology").alias("source"), F.col("o_orderkey").alias("member"))


VOTES = """v AS (SELECT c_nationkey AS grp, o_orderpriority AS description, CASE WHEN o_orderstatus = 'F' THEN 'direct' ELSE 'orthology' END AS source, o_orderkey AS member FROM orders JOIN customer ON o_custkey = c_custkey)"""
