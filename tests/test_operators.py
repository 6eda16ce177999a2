import math
import random

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import columns as C
from cladeframe.operators import evidence as E
from cladeframe.operators import prune as P
from cladeframe.operators import rounds as R
from cladeframe.operators import selection as L
from cladeframe.operators import sets as S
from cladeframe.operators import stats as T
from cladeframe.operators import topk as K
from cladeframe.operators import votes as V


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_margin_decides_and_ties_are_ambiguous(spark):
    rows = [("a", "F1", 200.0), ("a", "F2", 100.0), ("b", "F1", 200.0), ("b", "F2", 195.0), ("c", "F1", 1000.0), ("c", "F2", 970.0), ("d", "F2", 3135.2), ("d", "F1", 3135.2)]
    rows += [("e", f"F{i}", 100.0 + i) for i in range(7)] + [("f", "F1", 5.0)]
    hits = frame(spark, rows, "gene string, family string, bits double")
    got = K.with_margin(hits, "gene", "family", "bits", F.col("bits") > 10, F.greatest(F.lit(10.0), 0.05 * F.col("bits")))
    assert {r.gene: r.status for r in got.collect()} == {"a": "assigned", "b": "ambiguous", "c": "ambiguous", "d": "ambiguous", "e": "ambiguous", "f": "gated"}
    many = K.ambiguous_candidates(hits, got, "gene", "family", "bits").where("gene = 'e'").orderBy("rank").collect()
    assert [r.family for r in many] == ["F6", "F5", "F4", "F3", "F2"]
    strict = K.with_margin(hits, "gene", "family", "bits", F.lit(True), F.lit(0.0), strict=True)
    assert {r.gene: r.status for r in strict.collect()}["d"] == "ambiguous"


def test_reassignment(spark):
    hits = frame(spark, [("g", "own", 0.5, 1.0), ("g", "new", 0.7, 1.0), ("h", "own", 0.5, 1.0), ("h", "new", 0.6, 1.0), ("i", "own", 0.5, 1.0), ("i", "new", 0.9, 0.5), ("k", "new", 0.2, 0.9)], "gene string, family string, nbits double, cov double")
    current = frame(spark, [(g, "own") for g in "ghik"], "gene string, family string")
    got = {r.gene: r.to_family for r in K.reassignments(hits, current, "gene", "family", "nbits", "cov").collect()}
    assert got == {"g": "new", "k": "new"}


def test_embedding_tiebreak(spark):
    q = frame(spark, [("g", [1.0, 0.0], ["A", "B"]), ("one", [1.0, 0.0], ["A", "none"]), ("tie", [1.0, 1.0], ["A", "C"])], "gene string, v array<double>, candidates array<string>")
    m = frame(spark, [("A", [1.0, 0.0]), ("B", [1.0, 1.0]), ("C", [0.0, 1.0])], "family string, v array<double>")
    assert {r.gene: r.family for r in K.embedding_tiebreak(q, m, "gene", "v", "family").collect()} == {"g": "A", "one": "A", "tie": None}
    assert {r.gene: r.family for r in K.embedding_tiebreak(q, m, "gene", "v", "family", 0.5).collect()}["g"] is None


def test_weighted_names(spark):
    rows = [("f", "kinase", "direct")] + [("f", "PPC1", "orthology")] * 3 + [("t", "zeta", "direct"), ("t", "alpha", "orthology"), ("t", "alpha", "orthology"), ("", "x", "direct")]
    df = frame(spark, rows, "grp string, d string, s string")
    sizes = frame(spark, [("f", 8), ("t", 2)], "grp string, size long")
    got = {r.grp: r for r in V.weighted_names(df, "grp", "d", "s", {"direct": 1.0, "orthology": 0.5}, sizes).collect()}
    assert (got["f"]["name"], got["f"].support, got["f"].coverage, got["f"].provenance) == ("PPC1", 0.6, 0.5, "orthology")
    assert (got["t"]["name"], got["t"].provenance, got["t"].coverage) == ("zeta", "direct", 1.0) and set(got) == {"f", "t"}
    low = {r.grp: r for r in V.weighted_names(df, "grp", "d", "s", {"direct": 1.0, "orthology": 0.25}).collect()}
    assert low["f"]["name"] == "kinase" and low["f"].support == pytest.approx(1 / 1.75)


def test_consensus_refuses_ties(spark):
    df = frame(spark, [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", None)], "grp string, v string")
    c = V.consensus(df, "grp", "v")
    assert {r.grp: r.consensus for r in c.collect()} == {"a": "x", "b": None}
    assert [(r.grp, r.v) for r in V.disagreements(df, c, "grp", "v").collect()] == [("a", "y")]


def test_merge_candidates(spark):
    members = frame(spark, [("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B"), ("c1", "C")], "gene string, family string")
    hits = frame(spark, [("a1", "B", 9.0), ("a2", "B", 9.0), ("b1", "A", 9.0), ("b2", "A", 9.0), ("c1", "A", 9.0)], "gene string, family string, bits double")
    assert [tuple(r) for r in V.merge_candidates(hits, members, "gene", "family", "bits", F.lit(True)).collect()] == [("A", "B", 1.0)]


def test_structure_coherence(spark):
    groups = frame(spark, [("a1", "A"), ("a2", "A"), ("a3", "A"), ("b1", "B"), ("b2", "B")], "m string, grp string")
    pairs = frame(spark, [("a1", "a2", 900.0), ("a1", "a3", 880.0), ("a2", "a3", 910.0), ("b1", "b2", 950.0), ("a1", "b1", 400.0), ("a2", "b2", 420.0), ("a1", "zz", 999.0)], "a string, b string, best double")
    got = {r.grp: r for r in V.coherence(groups, pairs, "m", "grp").collect()}
    assert round(got["A"].within, 2) == 896.67 and got["A"].between == 410 and got["A"].coherent
    alone = V.coherence(groups, pairs.where("best > 800"), "m", "grp").where("grp = 'A'").first()
    assert alone.coherent is None


def test_evidence_scores_in_order_and_last_scan_wins(spark):
    stops = frame(spark, [("g1", 2)], "gene string, internal_stops long")
    lengths = frame(spark, [("g1", 0.5, ["cds_short"])], "gene string, length_ratio double, notes array<string>")
    orphan = frame(spark, [("g1", True), ("g2", True)], "gene string, orphan boolean")
    z = frame(spark, [("g3", 3.5), ("g1", None)], "gene string, zscore double")
    far = frame(spark, [("g4", 4.0)], "gene string, distance_ratio double")
    got = {r.gene: r for r in E.with_score(E.merge([stops, lengths, orphan, z, far], "gene")).collect()}
    assert {g: (round(r.score, 2), r["class"]) for g, r in got.items()} == {"g1": (1.0, "pseudogene_high"), "g2": (0.25, "pseudogene_medium"), "g3": (0.25, "pseudogene_medium"), "g4": (0.2, "pseudogene_low")}
    assert got["g1"].summary == "internal_stops=2;length_ratio=0.500;orphan;cds_short" and got["g4"].summary == "dist_ratio=4.00"


def test_scanners(spark):
    genes = frame(spark, [("a", "M*K*"), ("b", "MK**"), ("c", "MKL")], "gene string, seq string")
    assert [tuple(r) for r in E.internal_stops(genes, "gene", "seq").collect()] == [("a", 1)]
    gc = frame(spark, [("x", "ATGCCG-TTNA"), ("y", "ATG")], "gene string, cds string").select("gene", *E.composition(F.col("cds"))).collect()
    assert gc[0].gc == pytest.approx(4 / 9) and gc[0].gc3 == pytest.approx(2 / 3) and gc[1].gc is None
    sizes = frame(spark, [(f"g{i}", "F", n) for i, n in enumerate((100, 104, 40, 98))], "gene string, family string, n int")
    assert [r.gene for r in E.truncated(sizes, "gene", "family", "n").collect()] == ["g2"]


def test_pruning_fixture(spark):
    leaves = frame(spark, [("f", "S1_a", "S1", 0.1), ("f", "S4_b", "S4", 0.1), ("f", "S2_a", "S2", 0.1), ("f", "S2_fast", "S2", 2.0), ("f", "S3_bad", "S3", 0.1)], "family string, gene string, species string, terminal double")
    term = {r.gene: r.terminal for r in leaves.collect()}
    inner = lambda a, b: 4.0 if "S3_bad" in (a, b) else 0.8
    names = sorted(term)
    d = frame(spark, [("f", a, b, inner(a, b) + term[a] + term[b]) for i, a in enumerate(names) for b in names[i + 1 :]], "family string, a string, b string, d double")
    for scale in (1.0, 5.0):
        pairs = [(f"S{i}", f"S{j}", scale) for i in range(1, 5) for j in range(i + 1, 5)]
        expected = frame(spark, pairs, "sp_a string, sp_b string, d_exp double")
        got = {r.gene: (round(r.s_raw * scale, 6), round(r.s_norm, 6)) for r in P.relative_scores(leaves, P.pair_ratios(leaves, d, expected)).collect()}
        assert got["S2_fast"] == (0.8, 1.0) and got["S3_bad"] == (4.0, 5.0)
    one = frame(spark, [(f"S{i}", f"S{j}", 1.0) for i in range(1, 5) for j in range(i + 1, 5)], "sp_a string, sp_b string, d_exp double")
    assert [r.gene for r in P.pruned(leaves, d, one).where("outlier").collect()] == ["S3_bad"]


def test_rounds_place_or_recycle_and_resume(spark, tmp_path):
    pool = spark.range(60).select(F.format_string("g%02d", "id").alias("gene"))

    def place(pool, number):
        at = F.substring("gene", 2, 2).cast("int")
        return pool.select("gene", F.concat(F.lit("OG"), F.floor(at / 6).cast("string")).alias("group"), (at % 6 < 4 - number).alias("confirmed"))

    run = R.Rounds(spark, f"{tmp_path}/run")
    families, left = run.run(pool, place)
    assert {r.round for r in families.collect()} >= {1}
    placed = {r.gene for r in families.collect()}
    assert placed.isdisjoint({r.gene for r in left.collect()}) and len(placed) + left.count() == 60
    assert all(r.family.startswith(f"R{r.round}_OG") for r in families.collect())
    again, same = R.Rounds(spark, f"{tmp_path}/run").run(pool, lambda p, n: (_ for _ in ()).throw(AssertionError) if n <= run.last() else place(p, n))
    assert same.count() == left.count() and again.count() == families.count()


def test_benjamini_hochberg(spark):
    df = frame(spark, [(0.01,), (0.04,), (0.03,), (0.005,), (None,)], "p double")
    assert sorted((r.p, round(r.q, 6)) for r in T.benjamini_hochberg(df, "p").collect() if r.p is not None) == [(0.005, 0.02), (0.01, 0.02), (0.03, 0.04), (0.04, 0.04)]
    r = random.Random(0)
    ps = [round(r.random() ** 3, 3) for _ in range(300)]
    order = sorted(range(300), key=lambda i: ps[i])
    q, low = [0.0] * 300, 1.0
    for rank in range(300, 0, -1):
        low = min(low, ps[order[rank - 1]] * 300 / rank)
        q[order[rank - 1]] = low
    got = T.benjamini_hochberg(frame(spark, [(i, p) for i, p in enumerate(ps)], "i int, p double"), "p").collect()
    assert all(abs(x.q - q[x.i]) < 1e-12 for x in got)


def test_mann_whitney(spark):
    df = frame(spark, [(float(v), True) for v in (1, 2, 2, 4)] + [(float(v), False) for v in (2, 5, 6, 7)], "v double, a boolean")
    r = T.mann_whitney(df, "v", F.col("a")).first()
    assert r.u == 2.0 and r.p == pytest.approx(math.erfc(abs((2 - 8) / math.sqrt(12)) / math.sqrt(2)))
    assert T.mann_whitney(df.where("a"), "v", F.col("a")).first().p is None
    assert T.mann_whitney(df.limit(0), "v", F.col("a")).first().p is None


def test_unplaced_verdicts(spark):
    df = frame(spark, [("a", 5, 2, False), ("b", 2, 1, False), ("c", 3, 0, True), ("d", 1, 0, True), ("e", 1, 0, False)], "g string, n int, o int, h boolean")
    got = T.unplaced_verdicts(df, "g", "n", "o", "h")
    assert {r.g: r.verdict for r in got.collect()} == {"a": "PRUNED", "b": "SPLINTER", "c": "LINEAGE_ONLY", "d": "SINGLETON_HIT", "e": "SINGLETON_NOHIT"}
    roll = V.rollup(got, "verdict", {"x": ["PRUNED", "SPLINTER"], "y": ["NEVER"]})
    assert {r.bucket: r.n for r in roll.collect()} == {"x": 2, "y": 0}


@pytest.fixture(scope="module")
def small(spark):
    rows = [("s1", "-MKA", "big"), ("s2", "-MK-", "big"), ("s3", "AM--", "big"), ("s4", "-MK-"[:1] + "M--", "small"), ("s5", "GM--", "small")]
    return frame(spark, rows, "seq_id string, aligned string, grp string")


def test_columns(spark, small):
    cell = C.cells(small, "seq_id", "aligned", "grp")
    assert C.checked(small, "aligned").first().n_columns == 4
    occ = {r.col: r.occupancy for r in C.occupancy(cell).collect()}
    assert occ == {1: 0.4, 2: 1.0, 3: 0.4, 4: 0.2}
    cols = lambda df: sorted(r.col for r in df.collect())
    assert cols(C.select_columns(cell, 0.5)) == [2] and cols(C.select_columns(cell, 0.5, "grp")) == [1, 2, 3] and cols(C.select_columns(cell, 0.0)) == [1, 2, 3, 4]
    got = C.apply_columns(cell, C.select_columns(cell, 0.5, "grp"))
    assert {r.seq_id: r.aligned for r in got.collect()}["s1"] == "-MK"
    assert [(r.col, r.residue) for r in C.invariant_columns(cell, "grp").collect()] == [(2, "M")]
    assert C.choose_reference(small, "seq_id", "aligned").first().reference == "s1"
    with pytest.raises(Exception, match="different lengths"):
        C.checked(small.union(frame(spark, [("x", "M", "big")], "a string, b string, c string")), "aligned").collect()


def test_diagnostic_columns(spark):
    rows = [(f"a{i}", "MKLAAA", "A") for i in range(4)] + [(f"b{i}", "MSLAAA", "B") for i in range(4)]
    cell = C.cells(frame(spark, rows, "seq_id string, aligned string, grp string"), "seq_id", "aligned", "grp")
    got = C.diagnostic_columns(cell, "grp", min_group=3).collect()
    assert sorted((r.col, r.grp, r.residue) for r in got) == [(2, "A", "K"), (2, "B", "S")]
    assert C.diagnostic_columns(cell, "grp").count() == 0
    assert C.coverage_suppressed(cell, "grp").count() == 12


def test_translation_between_alignments(spark):
    a = C.cells(frame(spark, [("q", "-AC-G")], "s string, x string"), "s", "x")
    b = C.cells(frame(spark, [("q", "A-CG")], "s string, x string"), "s", "x")
    assert {r.col: r.to_col for r in C.translate_columns(a, b, "q").collect()} == {1: None, 2: 1, 3: 3, 4: None, 5: 4}
    assert {(r.kept, r.col, r.ref_pos) for r in C.column_map(a, a.where("col in (1, 3)"), "q").collect()} == {(1, 1, None), (2, 3, 2)}
    assert sorted(r.ungapped for r in C.columns_to_residues(a, "q", 3, 5).collect()) == [2, 3]


def test_codons_and_concatenation(spark):
    rows = frame(spark, [("a", "atg---CCCA"), ("b", "ATG---GGGT")], "s string, x string")
    assert {r.seq_id: r.aligned for r in C.drop_gap_codons(rows, "s", "x").collect()} == {"a": "ATGCCC", "b": "ATGGGG"}
    loci = frame(spark, [("l1", 6), ("l2", 3)], "locus string, width int")
    assert [(r.start, r.end) for r in T.running_offsets(loci, "locus", "width").orderBy("locus").collect()] == [(1, 6), (7, 9)]
    bt = frame(spark, [("M-K", "ATGAAA")], "p string, c string").select(L.back_translate(F.col("p"), F.col("c")).alias("x")).first().x
    assert bt == "ATG---AAA"


def test_diagnostic_columns_and_the_core(spark):
    roles = [("near", c, c in (10, 12), c in (11, 13), True) for c in range(1, 200)]
    roles += [("far", c, c in (150, 151, 152), c <= 20, c > 20) for c in range(1, 160)]
    roles += [("any", c, c % 9 == 0, c % 10 == 0, True) for c in range(1, 100)]
    roles += [("bare", 1, True, None, True), ("none", 1, None, True, True), ("few", 1, True, True, None)]
    df = frame(spark, roles, "aln string, col int, diagnostic boolean, core boolean, eligible boolean")
    got = {r.aln: r for r in C.core_relationships(df, "aln", n_null=200).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"near": C.NEAR, "far": C.AWAY, "any": C.INDEPENDENT, "bare": C.UNTESTABLE, "none": C.UNTESTABLE, "few": C.UNTESTABLE}
    assert got["near"].observed == 1.0 and got["far"].observed == 131.0 and got["near"].p_near == pytest.approx(1 / 201, abs=0.02)
    again = C.core_relationships(df.repartition(3), "aln", n_null=200)
    assert sorted(again.collect(), key=repr) == sorted(got.values(), key=repr)
    other = {r.aln: r.null_median for r in C.core_relationships(df, "aln", n_null=20, seed=5).collect()}
    assert other["near"] is not None and other["bare"] is None


def test_audits_and_merges(spark):
    ids = lambda *xs: frame(spark, [(x, x[:1]) for x in xs], "gene string, sp string")
    n = {r.sp: tuple(r)[1:] for r in S.id_agreement(ids("a1", "a2", "a3", "a4", "b1"), ids("a1", "a2", "b1"), "gene", "sp").collect()}
    assert n == {"a": (4, 2, 2, 50.0), "b": (1, 1, 1, 100.0)}
    assert [r.gene for r in S.conservation_audit(ids("a1", "a2", "a3"), ids("a1"), ids("a3"), "gene").collect()] == ["a2"]
    kept, out, unseen = S.partition_excluded(ids("a1", "b1"), "sp", ["b", "z"])
    assert (kept.count(), out.count(), unseen) == (1, 1, ["z"])
    m = S.axis_matrix([("x", frame(spark, [("g_1", 1)], "gene string, v int")), ("y", frame(spark, [("g.1", 2), ("h", 3)], "gene string, w int"))], "gene").collect()
    assert sorted((r.gene, r.x and r.x.v, r.y and r.y.w) for r in m) == [("g.1", 1, 2), ("h", None, 3)]
    a, b = frame(spark, [("g", "1.1", 0.0), ("h", "", 0.0)], "gene string, ec string, c double"), frame(spark, [("g", "2.2", 0.9), ("h", "3.3", 0.8), ("i", "4.4", 0.7)], "gene string, ec string, c double")
    assert sorted((r.gene, r.ec, r.agree) for r in S.merge_authoritative(a, b, "gene", "ec", "c").collect()) == [("g", "1.1", False), ("h", "3.3", None), ("i", "4.4", None)]


def test_selection_verdicts(spark):
    schema = "id int, relax_k double, relax_p double, stem array<string>, terminal array<string>, expression_share double, signal string, retargeting int, meme_in_region int, branchsite_p double, disorder_delta double, disorder_p double"
    rows = [(1, None, None, None, None, 0.9, "x", 3, None, None, None, None), (2, 0.6, 0.01, [], ["t"], None, "win", 0, 0, 0.01, None, None), (3, 0.6, 0.01, ["Node1"], [], None, None, 0, None, None, None, None), (4, 1.4, 0.01, [], [], 0.9, None, 0, 1, None, -0.3, 0.01)]
    got = {r.id: r for r in L.selection_verdict(frame(spark, rows, schema)).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["insufficient evidence", "subfunctionalization", "neofunctionalization", "conserved/inconclusive"]
    assert got[1].evidence_for == [] and len(got[2].evidence_against) == 2 and "signal region disordered" in got[4].evidence_for


def test_greedy_loci(spark):
    rows = [("c", 1, 100, 0.9, "a"), ("c", 90, 200, 0.95, "b"), ("c", 195, 300, 0.8, "c"), ("c", 201, 210, 0.5, "d"), ("d", 1, 5, 0.1, "e"), ("c", 400, 500, 0.7, "f")]
    got = L.best_per_locus(frame(spark, rows, "contig string, start int, end int, identity double, name string"), "contig", "start", "end", "identity")
    assert sorted(r.name for r in got.collect()) == ["b", "d", "e", "f"]
    reasons = frame(spark, [(0.9, "M" * 400), (0.99, "M*" + "M" * 400), (0.99, "MM"), (0.99, "M" * 300 + "*")], "i double, p string").select(L.acceptance(F.col("i"), F.col("p")).alias("x"))
    assert [r.x for r in reasons.collect()] == ["identity", "internal stop", "length", "ok"]


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if all(r[0] != k[0] or r[2] < k[1] or r[1] > k[2] for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("gap", [0, 25])
def test_loci_of_crowded_contigs(spark, gap):
    r = random.Random(11 + gap)
    rows = [(r.choice("aaab"), (lo := r.randrange(40000)), lo + r.choice([0, 5, 30, 200]), r.randrange(10**9) / 10**9, f"m{i}") for i in range(1500)]
    rows += [("long", 10 * i, 10 * i + 12, float(i % 7), f"l{i}") for i in range(400)] + [("long", 0, 9000, 0.5, "all"), ("e", 5, 5, 1.0, "p"), ("e", 5, 5, 1.0, "p")]
    models = frame(spark, [*rows, (None, 1, 2, 1.0, "x"), ("e", None, 2, 1.0, "y")], "contig string, start int, end int, identity double, name string").repartition(5)
    want = {}
    for contig in {x[0] for x in rows}:
        reach = locus = None
        for x in sorted((x for x in rows if x[0] == contig), key=lambda x: (x[1], x[2])):
            if reach is None or x[1] > reach + gap:
                locus = x[1]
            reach = max(x[2], x[2] if reach is None else reach)
            want.setdefault((contig, locus), []).append(x[4])
    got = {}
    for x in L.loci(models, "contig", "start", "end", gap).collect():
        got.setdefault((x.contig, x.locus), []).append(x.name)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    if gap == 0:
        kept = L.best_per_locus(models, "contig", "start", "end", "identity").collect()
        assert sorted(tuple(x) for x in kept) == sorted(greedy(rows))


def test_what_intervals_cover_together(spark):
    r = random.Random(8)
    rows = [(k, (lo := r.randrange(300)), lo + r.randrange(25)) for k in ("a", "b") for _ in range(60)] + [("c", 5, 5), ("c", 5, 5), ("c", 6, 6), ("d", -3, -1)]
    want = {k: len({p for x, lo, hi in rows if x == k for p in range(lo, hi + 1)}) for k in "abcd"}
    assert {x.k: x.covered for x in S.union_length(frame(spark, rows, "k string, lo int, hi int"), "k", "lo", "hi").collect()} == want


def test_batches_of_equal_cost(spark):
    r = random.Random(4)
    items = frame(spark, [(i, r.choice([30, 200, 210, 900, 2500])) for i in range(900)], "id int, length int").repartition(6)
    got = L.cost_batches(items, "length", 12, ["id"]).collect()
    cost = [0] * 12
    for x in got:
        cost[x.batch] += x.cost
    assert len(got) == 900 and max(cost) <= sum(cost) / 12 + max(x.cost for x in got)
    assert [x.batch for x in sorted(got)] == sorted(x.batch for x in got)
    one = L.cost_batches(items.limit(1), "length", 5, ["id"]).collect()
    assert len(one) == 1 and 0 <= one[0].batch < 5
    assert L.cost_batches(items.limit(0), "length", 5, ["id"]).count() == 0


def test_intervals(spark):
    sites = frame(spark, [(31,), (64,), (77,), (402,)], "site int")
    windows = frame(spark, [("u", 30, 64), ("v", 400, 402), ("w", 403, 420)], "w string, lo int, hi int")
    got = {(r.site, r.w) for r in S.interval_overlaps(sites, "site", windows, "lo", "hi").collect()}
    assert got == {(31, "u"), (64, "u"), (77, None), (402, "v")}


@pytest.mark.parametrize("by", [None, ["contig"]])
def test_intervals_of_all_widths_against_all_pairs(spark, by):
    r = random.Random(7)
    width = lambda: r.choice([0, 1, r.randrange(10), r.randrange(1000), r.randrange(10_000_000)])
    windows = [(f"w{i}", r.choice("cd"), (lo := r.randrange(-1000, 10_000_000)), lo + width()) for i in range(400)]
    windows += [("same", "c", 5, 5), ("same", "c", 5, 5), ("none", "c", None, 9), ("back", "d", 9, 3), ("all", "d", -(1 << 40), 1 << 40)]
    sites = [(r.choice("cd"), r.choice([w[2] or 0, (w[3] or 0) + 1, w[3] or 0, r.randrange(-1000, 10_000_000)])) for w in windows for _ in range(2)] + [("c", None), ("c", 5), ("c", 5)]
    got = S.interval_overlaps(frame(spark, sites, "contig string, at long"), "at", frame(spark, windows, "w string, contig string, lo long, hi long").drop(*([] if by else ["contig"])), "lo", "hi", by)
    want = []
    for c, at in sites:
        hit = [w for w in windows if at is not None and w[2] is not None and w[2] <= at <= w[3] and (by is None or w[1] == c)]
        want += [(c, at, w[0], w[2], w[3]) for w in hit] or [(c, at, None, None, None)]
    assert sorted(map(repr, (tuple(x) for x in got.select("contig", "at", "w", "lo", "hi").collect()))) == sorted(map(repr, want))
    spread = S.interval_matches(frame(spark, [(1,)], "at long"), "at", frame(spark, windows, "w string, contig string, lo long, hi long"), "lo", "hi")
    assert spread.count() == sum(1 for w in windows if w[2] is not None and w[2] <= 1 <= w[3])


@pytest.mark.parametrize("by", [None, ["contig"]])
def test_interval_summary_against_all_pairs(spark, by):
    r = random.Random(11)
    width = lambda: r.choice([0, 1, 2, 3, r.randrange(10), r.randrange(1000), r.randrange(10_000_000)])
    windows = [(r.choice("cd"), (lo := r.choice([r.randrange(-40, 40), r.randrange(-1000, 10_000_000)])), lo + width()) for _ in range(500)]
    windows += [("c", 5, 5), ("c", 5, 5), ("c", None, 9), ("d", 9, 3), ("d", -(1 << 40), 1 << 40), (None, 5, 6)]
    sites = [(r.choice("cd"), r.choice([w[1] or 0, (w[2] or 0) + 1, w[2] or 0, r.randrange(-50, 50)])) for w in windows] + [("c", None), ("c", 5), ("c", 5), (None, 5)]
    given = frame(spark, windows, "contig string, lo long, hi long").drop(*([] if by else ["contig"]))
    got = S.interval_summary(frame(spark, sites, "contig string, at long"), "at", given, "lo", "hi", by)
    want = []
    for c, at in sites:
        hit = [w[2] - w[1] for w in windows if at is not None and w[1] is not None and w[1] <= at <= w[2] and (by is None or (c is not None and w[0] == c))]
        want.append((c, at, len(hit), min(hit, default=None), max(hit, default=None)))
    assert sorted(map(repr, (tuple(x) for x in got.collect()))) == sorted(map(repr, want))


def test_interval_summary_lists_no_matches(spark):
    """30,000 windows over each of 30,000 sites: 900 million matches, counted in seconds."""
    sites = spark.range(30_000).select(F.col("id").alias("site"), (F.col("id") + 100_000).alias("at"))
    windows = spark.range(30_000).select(F.col("id").alias("lo"), (F.col("id") + 200_000).alias("hi"))
    out = S.interval_summary(sites, "at", windows, "lo", "hi").agg(F.count("*"), F.sum("n_windows"), F.min("narrowest"), F.max("widest")).first()
    assert tuple(out) == (30_000, 900_000_000, 200_000, 200_000)


def test_tasks_grow_with_rows(spark, monkeypatch):
    """A task's share of a spread table is bounded, whatever the number of shuffle partitions; grouping by its keys keeps the deal."""
    monkeypatch.setattr("cladeframe.stage.TASK_ROWS", 100)
    rows = spark.range(4000).select((F.col("id") % 1000).alias("a"), ((F.col("id") + 1) % 1000).alias("b"), F.col("id").alias("s"))
    best = V.unordered_best(rows, "a", "b", "s", 4000)
    per = best.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(p["count"] for p in per) == 1000 and len(per) > 30 and max(p["count"] for p in per) < 100
    assert {(r.a, r.b): r.best for r in best.collect()} == {(min(i, (i + 1) % 1000), max(i, (i + 1) % 1000)): i + 3000 for i in range(1000)}


def test_sites_with_their_windows_signals(spark):
    sites = frame(spark, [(3, "K"), (8, "L"), (3, "M"), (99, "N"), (None, "O")], "site int, aa string")
    windows = frame(spark, [(1, 5, "q2", "mTP"), (2, 9, "q1", ""), (2, 3, "q2", "SP"), (3, 3, "q1", None), (50, 40, "q9", "SP")], "lo int, hi int, seq string, sig string")
    got = {r.aa: (r.n_windows, r.window_seqs, r.signals) for r in S.crossed_windows(sites, "site", windows, "lo", "hi", "seq", "sig").collect()}
    assert got == {"K": (4, "q1,q2", "SP;mTP"), "M": (4, "q1,q2", "SP;mTP"), "L": (1, "q1", ""), "N": (0, "", ""), "O": (0, "", "")}


def test_medians_of_groups_of_any_size(spark):
    import random
    import statistics

    from cladeframe.operators.stats import group_medians

    r = random.Random(3)
    rows = [("hot", float(r.randrange(50)) if i % 2 else r.random()) for i in range(4001)]
    rows += [(f"k{i % 37}", r.choice([0.5, 1.5, 2.0, None])) for i in range(1500)] + [(None, 1.0), (None, 4.0), ("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert {x.k: x.m for x in group_medians(df, ["k"], "v", "m").collect()} == {k: statistics.median(v) for k, v in by.items()}
    two = group_medians(df.withColumn("j", F.pmod(F.hash("v"), F.lit(3))), ["k", "j"], "v", "m")
    want = df.withColumn("j", F.pmod(F.hash("v"), F.lit(3))).where("v IS NOT NULL").groupBy("k", "j").agg(F.median("v").alias("m"))
    assert sorted(map(repr, two.select("k", "j", "m").collect())) == sorted(map(repr, want.collect()))
    assert group_medians(df.limit(0), ["k"], "v", "m").count() == 0


def test_a_key_with_half_of_the_rows_is_ranked_by_many_tasks(spark):
    from cladeframe.operators.stats import group_medians

    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"), (F.xxhash64("id") % 1000003).cast("double").alias("v"))
    out = group_medians(df, ["k"], "v", "m")
    assert out.where("k = 'hot'").first().m == df.where("k = 'hot'").agg(F.median("v")).first()[0]
    from cladeframe.stage import in_ranges

    sizes = [r["n"] for r in in_ranges(df, ["k", "v"], "sizes").groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * (sum(sizes) / len(sizes)), "the ranges that the ranks are taken in are near equal"


def test_medians_by_bins_rank_the_middle_only(spark, monkeypatch):
    """Values of either sign, zeros, infinities, ties, null keys: the medians of group_medians, though few values are ranked."""
    import random

    from cladeframe.operators import stats as T

    r = random.Random(5)
    rows = [("wide", r.uniform(-50, 100)) for _ in range(3000)] + [("even", v) for v in (-2.0, -1.0, 0.0, 5.0)] + [("zero", v) for v in (0.0, -0.0, 1e-300, -1e-300, 0.0)]
    rows += [("ends", v) for v in (float("inf"), float("-inf"), 3.0, float("nan"))] + [(None, 1.0), (None, 4.0), ("none", None), ("same", 2.5), ("same", 2.5), ("apart", 1.0), ("apart", 9.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    seen, rank = [], T._medians
    monkeypatch.setattr(T, "_medians", lambda counted, *a: seen.append(counted.agg(F.sum("_c")).first()[0]) or rank(counted, *a))
    got = {x.k: x.m for x in T.dense_medians(df, ["k"], "v", "m").collect()}
    assert got == {x.k: x.m for x in T.group_medians(df, ["k"], "v", "m").collect()} and got["even"] == -0.5 and got["apart"] == 5.0
    assert seen[0] < 150 < 3000 < seen[1]
    assert T.dense_medians(df.limit(0), ["k"], "v", "m").count() == 0
