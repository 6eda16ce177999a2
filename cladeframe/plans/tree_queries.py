"""Alignments by column and trees as tables, over customers, nations and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import columns as C
from cladeframe.operators import forest as W
from cladeframe.operators import trees as R
from cladeframe.plans.catalog import query
from cladeframe.plans.views import ALIGNMENT, TREE, alignment, t, tree

OCC = "occ AS (SELECT col, avg(CASE WHEN residue <> '-' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS occupancy FROM cells GROUP BY col)"
GOCC = "gocc AS (SELECT grp, col, avg(CASE WHEN residue <> '-' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS occupancy, count(*) AS n FROM cells GROUP BY 1, 2)"


def _cells(spark, sf_dir):
    return C.cells(alignment(spark, sf_dir), "seq_id", "aligned", "grp", "clan")


@query(f"WITH {ALIGNMENT}, {OCC} SELECT col, round(occupancy, 6) AS occupancy FROM occ")
def column_occupancy(spark, sf_dir):
    return C.occupancy(_cells(spark, sf_dir)).select(F.col("col").cast("long").alias("col"), F.round("occupancy", 6).alias("occupancy"))


@query(f"WITH {ALIGNMENT}, {GOCC} SELECT grp, col, round(occupancy, 6) AS occupancy FROM gocc")
def group_occupancy(spark, sf_dir):
    return C.occupancy(_cells(spark, sf_dir), "grp").select("grp", F.col("col").cast("long").alias("col"), F.round("occupancy", 6).alias("occupancy"))


SELECTED = f"{ALIGNMENT}, {GOCC}, sel AS (SELECT col FROM gocc GROUP BY col HAVING max(occupancy) >= CAST(0.95 AS DOUBLE) AND max(occupancy) > 0)"


@query(f"WITH {SELECTED} SELECT col FROM sel")
def select_columns(spark, sf_dir):
    return C.select_columns(_cells(spark, sf_dir), 0.95, "grp").select(F.col("col").cast("long").alias("col"))


@query(f"WITH {SELECTED} SELECT seq_id, string_agg(residue, '' ORDER BY c.col) AS aligned FROM cells c JOIN sel ON c.col = sel.col GROUP BY seq_id")
def apply_columns(spark, sf_dir):
    cell = _cells(spark, sf_dir)
    return C.apply_columns(cell, C.select_columns(cell, 0.95, "grp"))


TOPS = f"""{ALIGNMENT}, rc AS (SELECT grp, col, residue, count(*) AS c FROM cells GROUP BY 1, 2, 3), tt AS (SELECT grp, col, sum(c) AS n, sum(c) FILTER (residue <> '-') AS filled FROM rc GROUP BY 1, 2),
tp AS (SELECT grp, col, residue, c, row_number() OVER (PARTITION BY grp, col ORDER BY c DESC, ascii(residue)) AS rn FROM rc WHERE residue <> '-'),
tops AS (SELECT tt.grp, tt.col, tp.residue, tp.c, coalesce(filled, 0) AS filled, n FROM tt LEFT JOIN tp ON tt.grp = tp.grp AND tt.col = tp.col AND rn = 1)"""


@query(f"WITH {TOPS} SELECT col, min(residue) AS residue FROM tops GROUP BY col HAVING bool_and(coalesce(filled >= CAST(0.7 AS DOUBLE) * n AND filled > 0 AND c >= CAST(0.95 AS DOUBLE) * filled, FALSE)) AND min(residue) = max(residue)")
def invariant_columns(spark, sf_dir):
    return C.invariant_columns(_cells(spark, sf_dir), "grp").select(F.col("col").cast("long").alias("col"), "residue")


@query(
    f"""WITH {TOPS}, af AS (SELECT col, count(*) AS n FROM cells WHERE residue <> '-' GROUP BY 1), ar AS (SELECT col, residue, count(*) AS n FROM cells WHERE residue <> '-' GROUP BY 1, 2),
s AS (SELECT t.col, grp, t.residue, CAST(c AS DOUBLE) / CAST(filled AS DOUBLE) AS inf, CASE WHEN af.n > filled THEN CAST(ar.n - c AS DOUBLE) / CAST(af.n - filled AS DOUBLE) END AS outf, CAST(filled AS DOUBLE) / CAST(t.n AS DOUBLE) AS cover
  FROM tops t JOIN af ON t.col = af.col JOIN ar ON t.col = ar.col AND t.residue = ar.residue WHERE t.n >= 5 AND filled > 0)
SELECT col, grp, residue, round(inf, 6) AS in_freq, round(outf, 6) AS out_freq, round(cover, 6) AS cover FROM s WHERE cover >= CAST(0.7 AS DOUBLE) AND inf >= CAST(0.8 AS DOUBLE) AND outf <= CAST(0.2 AS DOUBLE)"""
)
def sdp_scan(spark, sf_dir):
    out = C.diagnostic_columns(_cells(spark, sf_dir), "grp")
    return out.select(F.col("col").cast("long").alias("col"), "grp", "residue", *[F.round(c, 6).alias(c) for c in ("in_freq", "out_freq", "cover")])


@query(f"WITH {ALIGNMENT}, {GOCC} SELECT grp, col, round(occupancy, 6) AS occupancy, CASE WHEN n < 5 THEN 'small group' ELSE 'low cover' END AS reason FROM gocc WHERE occupancy < CAST(0.7 AS DOUBLE) OR n < 5")
def coverage_suppressed(spark, sf_dir):
    return C.coverage_suppressed(_cells(spark, sf_dir), "grp").select("grp", F.col("col").cast("long").alias("col"), F.round("occupancy", 6).alias("occupancy"), "reason")


@query(
    f"""WITH {ALIGNMENT}, r AS (SELECT seq_id, grp, length(replace(aligned, '-', '')) AS n, row_number() OVER (PARTITION BY grp ORDER BY length(replace(aligned, '-', '')) DESC, seq_id) AS rn FROM a) SELECT grp, seq_id AS reference, n AS residues FROM r WHERE rn = 1"""
)
def choose_reference(spark, sf_dir):
    return C.choose_reference(alignment(spark, sf_dir), "seq_id", "aligned", "grp")


@query(
    f"""WITH {ALIGNMENT}, k AS (SELECT seq_id, col, residue, CASE WHEN residue <> '-' THEN count(*) FILTER (residue <> '-') OVER (PARTITION BY seq_id ORDER BY col) END AS ungapped FROM cells),
p AS (SELECT col, max(ungapped) AS deepest, count(ungapped) AS filled FROM k GROUP BY col) SELECT col, deepest, filled FROM p"""
)
def residue_numbering(spark, sf_dir):
    k = C.residue_numbers(_cells(spark, sf_dir))
    return k.groupBy(F.col("col").cast("long").alias("col")).agg(F.max("ungapped").alias("deepest"), F.count("ungapped").alias("filled"))


@query(
    f"""WITH {ALIGNMENT}, src AS (SELECT col, CASE WHEN residue <> '-' THEN count(*) FILTER (residue <> '-') OVER (ORDER BY col) END AS u FROM cells WHERE seq_id = 7),
dst AS (SELECT i AS to_col, row_number() OVER (ORDER BY i) AS u FROM (SELECT CAST(i AS BIGINT) AS i, substr((SELECT replace(aligned, '-', '') FROM a WHERE seq_id = 7), CAST(i AS BIGINT), 1) AS r FROM range(1, 32) t(i)) WHERE r <> '')
SELECT col, to_col FROM src LEFT JOIN dst ON src.u = dst.u"""
)
def column_translate(spark, sf_dir):
    rows = alignment(spark, sf_dir)
    bare = rows.withColumn("aligned", F.replace("aligned", F.lit("-"), F.lit("")))
    out = C.translate_columns(C.cells(rows, "seq_id", "aligned"), C.cells(bare, "seq_id", "aligned"), 7)
    return out.select(F.col("col").cast("long").alias("col"), F.col("to_col").cast("long").alias("to_col"))


@query(
    f"""WITH {ALIGNMENT}, c AS (SELECT clan, seq_id, CAST(i AS BIGINT) AS pos, substr(aligned, CAST(3 * i + 1 AS BIGINT), 3) AS codon FROM a, range(0, 10) r(i)), k AS (SELECT clan, pos FROM c GROUP BY 1, 2 HAVING bool_or(codon <> '---'))
SELECT c.clan, seq_id, string_agg(codon, '' ORDER BY c.pos) AS aligned FROM c JOIN k ON c.clan = k.clan AND c.pos = k.pos GROUP BY 1, 2"""
)
def codon_gap_drop(spark, sf_dir):
    return C.drop_gap_codons(alignment(spark, sf_dir), "seq_id", "aligned", "clan")


@query(
    f"""WITH {ALIGNMENT} SELECT clan, substr(sha256(string_agg(CAST(seq_id AS VARCHAR) || chr(9) || aligned || chr(10), '' ORDER BY CAST(seq_id AS VARCHAR))), 1, 16) AS digest, max(length(aligned)) AS n_columns, count(*) AS n_sequences FROM a GROUP BY clan"""
)
def alignment_stamp(spark, sf_dir):
    return C.stamp(alignment(spark, sf_dir), "seq_id", "aligned", "clan")


@query(
    f"""WITH {ALIGNMENT}, m AS (SELECT clan, grp, min(aligned) AS aligned FROM a GROUP BY 1, 2) SELECT clan AS species, string_agg(aligned, '' ORDER BY grp) AS aligned, count(*) AS n_loci FROM m GROUP BY clan"""
)
def supermatrix(spark, sf_dir):
    m = alignment(spark, sf_dir).groupBy("clan", "grp").agg(F.min("aligned").alias("aligned"))
    return C.concatenated(m, "grp", "clan", "aligned").withColumnRenamed("clan", "species")


@query(f"WITH {ALIGNMENT} SELECT grp, count(*) FILTER (NOT contains(rtrim(rtrim(replace(aligned, '0', '*'), '-.'), '*'), '*')) AS kept, count(*) AS n FROM a GROUP BY grp")
def filter_internal_stops(spark, sf_dir):
    rows = alignment(spark, sf_dir).withColumn("aligned", F.replace("aligned", F.lit("0"), F.lit("*")))
    return rows.groupBy("grp").agg(F.count_if(C.without_stops(rows, "aligned")).alias("kept"), F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT s_suppkey AS member, s_nationkey < 5 AS focal FROM supplier), li AS (SELECT l_suppkey AS member, l_linenumber AS residue, l_quantity AS value FROM lineitem),
m AS (SELECT member, count(*) FILTER (residue BETWEEN 3 AND 5) AS n_region, avg(value) FILTER (residue BETWEEN 3 AND 5) AS r, avg(value) AS w FROM li GROUP BY 1)
SELECT m.member, focal, n_region, round(CASE WHEN n_region >= 250 THEN r - w END, 6) AS delta, CASE WHEN n_region < 250 THEN 'too few residues' END AS skipped FROM m JOIN v ON m.member = v.member"""
)
def region_contrast(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), (F.col("s_nationkey") < 5).alias("focal"))
    li = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_linenumber").alias("residue"), F.col("l_quantity").alias("value")).join(s, "member")
    return C.region_contrast(li, "member", "residue", "value", F.col("residue").between(3, 5), F.col("focal"), 250).withColumn("delta", F.round("delta", 6))


@query(
    f"""WITH {ALIGNMENT}, o AS (SELECT clan, col, avg(CASE WHEN residue <> '-' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS occ FROM cells GROUP BY 1, 2), c AS (SELECT clan, col, occ > 0.3 AND occ < 0.8 AS dia, occ = 1 AS core, occ > 0 AS eli FROM o),
k AS (SELECT x.clan, x.col, min(abs(x.col - y.col)) AS away FROM c x JOIN c y ON x.clan = y.clan AND y.core GROUP BY 1, 2), n AS (SELECT c.clan, count(*) FILTER (dia) AS n_diagnostic, count(*) FILTER (core) AS n_core, count(*) FILTER (eli) AS n_eligible, median(away) FILTER (dia) AS observed FROM c LEFT JOIN k ON c.clan = k.clan AND c.col = k.col GROUP BY 1),
d AS (SELECT c.clan, c.col, k.away, n_diagnostic, observed, i AS draw, row_number() OVER (PARTITION BY c.clan, i ORDER BY md5(concat_ws('|', '0', CAST(c.clan AS VARCHAR), CAST(i AS VARCHAR), CAST(c.col AS VARCHAR))), c.col) AS r FROM c JOIN k ON c.clan = k.clan AND c.col = k.col JOIN n ON c.clan = n.clan, range(1, 101) t(i) WHERE eli AND n_diagnostic > 0 AND n_core > 0 AND n_eligible >= n_diagnostic),
u AS (SELECT clan, draw, median(away) AS m, min(observed) AS o FROM d WHERE r <= n_diagnostic GROUP BY 1, 2), p AS (SELECT clan, median(m) AS null_median, (1 + count(*) FILTER (m <= o)) / CAST(101 AS DOUBLE) AS p_near, (1 + count(*) FILTER (m >= o)) / CAST(101 AS DOUBLE) AS p_far FROM u GROUP BY 1)
SELECT n.clan, n_diagnostic, n_core, n_eligible, observed, null_median, round(p_near, 6) AS p_near, round(p_far, 6) AS p_far,
  CASE WHEN p_near IS NULL THEN 'not testable' WHEN p_near <= CAST(0.05 AS DOUBLE) THEN 'near the core' WHEN p_far <= CAST(0.05 AS DOUBLE) THEN 'away from the core' ELSE 'independent of the core' END AS verdict FROM n LEFT JOIN p ON n.clan = p.clan"""
)
def diagnostic_core_distance(spark, sf_dir):
    """Half-filled columns of each clan's alignment against its full ones, and against 100 draws of its columns."""
    filled = F.when(F.col("residue") != "-", 1.0).otherwise(0.0)
    occ = _cells(spark, sf_dir).groupBy("clan", "col").agg(F.avg(filled).alias("occ"))
    o = F.col("occ")
    roles = occ.select("clan", "col", ((o > 0.3) & (o < 0.8)).alias("diagnostic"), (o == 1).alias("core"), (o > 0).alias("eligible"))
    out = C.core_relationships(roles, "clan", n_null=100)
    return out.withColumns({c: F.round(c, 6) for c in ("p_near", "p_far")})


def _nodes(spark, sf_dir):
    return R.from_parents(tree(spark, sf_dir), "node", "parent", "name").withColumn("tree_id", F.lit("t"))


@query(f"WITH RECURSIVE {TREE} SELECT anc, anc_depth, leaf FROM closure")
def tree_closure(spark, sf_dir):
    return R.closure(_nodes(spark, sf_dir)).select(F.col("anc_id").alias("anc"), F.col("anc_depth").cast("long").alias("anc_depth"), "leaf")


@query(
    f"""WITH RECURSIVE {TREE}, ld AS (SELECT leaf, max(anc_depth) AS d FROM closure GROUP BY leaf), p AS (SELECT a.leaf AS a, b.leaf AS b, max(a.anc_depth) AS k FROM closure a JOIN closure b ON a.anc = b.anc AND a.leaf < b.leaf GROUP BY 1, 2)
SELECT p.a, p.b, CAST(x.d + y.d - 2 * k AS DOUBLE) AS distance FROM p JOIN ld x ON p.a = x.leaf JOIN ld y ON p.b = y.leaf"""
)
def patristic_distance(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumn("root_dist", F.col("depth").cast("double"))
    return R.patristic(nodes).select("a", "b", "distance")


GROUPS = "gl AS (SELECT CASE WHEN s_nationkey = 3 THEN 'one' WHEN s_acctbal > 9500 THEN 'rich' WHEN n_regionkey = 2 AND s_acctbal > 5000 THEN 'part' WHEN s_nationkey = 99 THEN 'none' ELSE 'rest' END AS grp, s_name AS leaf FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
MONO = f"""{GROUPS}, tot AS (SELECT grp, count(DISTINCT leaf) AS n FROM gl GROUP BY 1), cov AS (SELECT grp, anc, anc_depth, count(DISTINCT gl.leaf) AS n FROM closure c JOIN gl ON c.leaf = gl.leaf GROUP BY 1, 2, 3),
top AS (SELECT c.grp, max_by(anc, anc_depth) AS mrca, max(anc_depth) AS depth, max(c.n) AS n FROM cov c JOIN tot ON c.grp = tot.grp AND c.n = tot.n GROUP BY 1),
und AS (SELECT top.grp, count(*) AS n_under, count(*) FILTER (g.leaf IS NULL) AS n_intruders FROM closure c JOIN top ON c.anc = top.mrca LEFT JOIN gl g ON g.grp = top.grp AND g.leaf = c.leaf GROUP BY 1),
span AS (SELECT max(anc_depth) AS d FROM (SELECT anc, anc_depth, count(DISTINCT leaf) AS n FROM closure GROUP BY 1, 2) WHERE n = (SELECT count(DISTINCT leaf) FROM closure))"""


def _groups(spark, sf_dir):
    s, n = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "nation")
    grp = F.when(F.col("s_nationkey") == 3, "one").when(F.col("s_acctbal") > 9500, "rich").when((F.col("n_regionkey") == 2) & (F.col("s_acctbal") > 5000), "part").otherwise("rest")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(grp.alias("grp"), F.col("s_name").alias("leaf"))


@query(f"WITH RECURSIVE {TREE}, {MONO} SELECT top.grp, mrca AS mrca_id, depth AS mrca_depth, top.n AS n_in_tree, n_under, n_intruders, n_intruders = 0 AS monophyletic FROM top JOIN und ON top.grp = und.grp")
def mrca_monophyly(spark, sf_dir):
    out = R.monophyly(R.closure(_nodes(spark, sf_dir)), _groups(spark, sf_dir), "grp")
    return out.select("grp", "mrca_id", F.col("mrca_depth").cast("long").alias("mrca_depth"), "n_in_tree", "n_under", F.size("intruders").cast("long").alias("n_intruders"), "monophyletic")


@query(f"WITH RECURSIVE {TREE}, {MONO} SELECT top.grp, CASE WHEN n_intruders > 0 THEN 'paralog-split (non-monophyletic)' WHEN depth = (SELECT d FROM span) THEN 'paralog-split (spans family root)' ELSE 'lineage-specific (clade)' END AS verdict FROM top JOIN und ON top.grp = und.grp")
def taxonomic_composition(spark, sf_dir):
    return R.composition(R.closure(_nodes(spark, sf_dir)), _groups(spark, sf_dir), "grp").select("grp", "verdict")


@query(
    f"""WITH RECURSIVE {TREE}, f AS (SELECT s_name AS leaf, CAST(floor(s_acctbal / 2500) AS BIGINT) AS family FROM supplier), c AS (SELECT anc, family, count(*) AS n FROM closure JOIN f ON closure.leaf = f.leaf GROUP BY 1, 2),
m AS (SELECT anc, max(n) AS top FROM c GROUP BY 1) SELECT c.anc, min(family) AS family FROM c JOIN m ON c.anc = m.anc AND n = top GROUP BY c.anc HAVING count(*) = 1"""
)
def edge_majority_family(spark, sf_dir):
    f = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("leaf"), F.floor(F.col("s_acctbal") / 2500).alias("family"))
    return R.edge_family(R.closure(_nodes(spark, sf_dir)), f, "family").select(F.col("anc_id").alias("anc"), "family")


FITCH = f"""{TREE}, st AS (SELECT 's' || s_suppkey AS node, CAST(CAST(floor(s_acctbal / 3400) AS BIGINT) AS VARCHAR) AS s FROM supplier), nl AS (SELECT t.parent AS node, s FROM tree t JOIN st ON t.node = st.node),
nv AS (SELECT node, s, count(*) AS c, sum(count(*)) OVER (PARTITION BY node) AS v FROM nl GROUP BY 1, 2), ns AS (SELECT node, s FROM nv WHERE c = v UNION ALL SELECT node, s FROM nv WHERE node NOT IN (SELECT node FROM nv WHERE c = v)),
rl AS (SELECT t.parent AS node, s FROM tree t JOIN ns ON t.node = ns.node), rk AS (SELECT t.parent AS node, count(DISTINCT ns.node) AS v FROM tree t JOIN ns ON t.node = ns.node GROUP BY 1),
rc AS (SELECT rl.node, s, count(*) AS c, max(v) AS v FROM rl JOIN rk ON rl.node = rk.node GROUP BY 1, 2), rs AS (SELECT node, s FROM rc WHERE c = v UNION ALL SELECT node, s FROM rc WHERE node NOT IN (SELECT node FROM rc WHERE c = v)),
tk AS (SELECT count(DISTINCT node) AS v FROM rs), tc AS (SELECT s, count(*) AS c FROM rs GROUP BY 1), ts AS (SELECT s FROM tc WHERE c = (SELECT v FROM tk) UNION ALL SELECT s FROM tc WHERE NOT EXISTS (SELECT 1 FROM tc WHERE c = (SELECT v FROM tk))),
d0 AS (SELECT 'root' AS node, min(s) AS state FROM ts), d1 AS (SELECT rs.node, CASE WHEN bool_or(rs.s = d0.state) THEN max(d0.state) ELSE min(rs.s) END AS state FROM rs, d0 GROUP BY rs.node),
d2 AS (SELECT ns.node, CASE WHEN bool_or(ns.s = d1.state) THEN max(d1.state) ELSE min(ns.s) END AS state FROM ns JOIN tree t ON ns.node = t.node JOIN d1 ON t.parent = d1.node GROUP BY ns.node),
al AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT node, s FROM st)"""


@query(f"WITH RECURSIVE {FITCH} SELECT c.node AS child_id, p.state AS parent_state, c.state AS child_state FROM al c JOIN tree t ON c.node = t.node JOIN al p ON t.parent = p.node WHERE c.state <> p.state")
def fitch_switches(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    s = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.floor(F.col("s_acctbal") / 3400).cast("string").alias("state"))
    return R.switches(nodes, W.parsimony(nodes, s))


ASKED = "ask AS (SELECT DISTINCT 's' || a.l_suppkey AS a, 's' || b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linenumber = 1)"


@query(
    f"""WITH RECURSIVE {TREE}, {ASKED}, k AS (SELECT ask.a, ask.b, max(d.depth) AS depth FROM ask JOIN up x ON ask.a = x.node JOIN up y ON ask.b = y.node AND x.anc = y.anc JOIN depths d ON x.anc = d.node GROUP BY 1, 2)
SELECT k.a, k.b, x.anc AS lca, CAST(p.depth + q.depth - 2 * k.depth AS BIGINT) AS steps FROM k JOIN up x ON k.a = x.node JOIN depths d ON x.anc = d.node AND d.depth = k.depth JOIN depths p ON k.a = p.node JOIN depths q ON k.b = q.node"""
)
def asked_distances(spark, sf_dir):
    """The shared node and the steps between suppliers that follow each other in an order: of pairs asked for, not of all."""
    nodes = tree(spark, sf_dir).select(F.lit("t").alias("tree_id"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"))
    li = t(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 2)").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node"))
    a, b = (li.where(F.col("l_linenumber") == n).select("l_orderkey", F.col("node").alias(k)) for n, k in ((1, "a"), (2, "b")))
    asked = a.join(b, "l_orderkey").select(F.lit("t").alias("tree_id"), "a", "b").distinct()
    return W.lowest_common(W.jump_table(nodes), asked).select("a", "b", "lca", "steps")
