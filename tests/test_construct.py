"""The construction chain over small scripts in the place of tools."""

import sys

import pytest
from pyspark.sql import functions as F

from cladeframe.config import Settings
from cladeframe.operators import construct as C
from cladeframe.operators.rounds import Rounds
from cladeframe.sources import reports, text
from cladeframe.sources import tools as X

#: Pads sequences to one length; fails on a group that holds the gene "broken".
ALIGN = """
import sys
rows = [r.split("\\n") for r in open(sys.argv[1]).read().split(">") if r.strip()]
if any(r[0] == "broken" for r in rows):
    sys.exit("cannot align")
width = max(len(r[1]) for r in rows)
open(sys.argv[2], "w").write("".join(f">{r[0]}\\n{r[1].ljust(width, '-')}\\n" for r in rows))
"""
#: A comb whose last leaf has a long branch if its name ends in "far".
TREE = """
import sys
names = sorted(r.split("\\n")[0] for r in open(sys.argv[1]).read().split(">") if r.strip())
tree = names[0] + ":1"
for n in names[1:]:
    tree = f"({tree},{n}:{40 if n.endswith('far') else 1}):1"
open(sys.argv[2], "w").write(tree + ";")
"""


@pytest.fixture(scope="module")
def chain(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tools")

    def tool(name, code):
        (folder / name).write_text(code)
        return X.Tool(name, f"{sys.executable} {folder / name} {{input}} {{output}}")

    return C.Chain(tool("align", ALIGN), tool("tree", TREE), tool("outliers", "import sys\nt = open(sys.argv[1]).read()\nopen(sys.argv[2], 'w').write('a_odd' if 'a_odd' in t else '')\n"))


GENES = {"g1": ["a_1", "b_1", "c_1", "d_1"], "g2": ["a_2", "b_2", "c_2", "broken"], "g3": ["a_odd", "a_3", "b_3", "c_3"], "g4": ["a_4", "b_4"]}


def tables(spark):
    rows = [(g, x, "MKV" + "A" * i) for g, xs in GENES.items() for i, x in enumerate(xs)]
    members = spark.createDataFrame(rows, "group string, gene string, seq string")
    species = members.select("gene", F.when(F.col("gene") == "broken", "d").otherwise(F.split_part("gene", F.lit("_"), F.lit(1))).alias("species"))
    expected = spark.createDataFrame([(p, q, 4.0) for p in "abcd" for q in "abcd" if p < q], "sp_a string, sp_b string, d_exp double")
    return members, species, expected


def test_groups_go_through_the_chain_and_none_is_lost(spark, chain):
    members, species, expected = tables(spark)
    got = {(r.group, r.gene): (r.confirmed, r.error) for r in C.orthogroups(members, species, expected, chain).collect()}
    assert set(got) == {(g, x) for g, xs in GENES.items() for x in xs}
    assert all(got["g1", x] == (True, None) for x in GENES["g1"]) and all(got["g4", x] == (True, None) for x in GENES["g4"])
    assert all(not got["g2", x][0] and "cannot align" in got["g2", x][1] for x in GENES["g2"])
    assert not got["g3", "a_odd"][0] and all(got["g3", x][0] for x in GENES["g3"][1:])


def test_rounds_build_families_and_resume(spark, chain, tmp_path):
    members, species, expected = tables(spark)
    calls = []

    def cluster(pool, number):
        calls.append(number)
        return members.select("group", "gene").join(pool, "gene", "left_semi")

    place = C.placing(cluster, members.select("gene", "seq"), species, expected, chain)
    for most in (1, 3):  # stopped after a round, then taken up again
        s = Settings(max_rounds=most, min_orthogroup_size=2, convergence_threshold=1)
        families, pool = Rounds(spark, str(tmp_path / "run"), s).run(members.select("gene"), place)
    assert calls == [1, 2, 3]
    named = {r.gene: r.family for r in families.collect()}
    left = {r.gene for r in pool.collect()}
    assert set(named) | left == {x for xs in GENES.values() for x in xs} and not set(named) & left
    assert left == {*GENES["g2"], "a_odd"} and named["c_3"] == "R1_g3"


def test_outliers_are_the_union_of_detector_and_ratio(spark):
    trees = spark.createDataFrame([("f", "((a_1:1,b_1:1):1,(c_1:1,(d_1:1,b_9:60):1):1);"), ("few", "(a_2:1,b_2:90);")], "family string, newick string")
    species = spark.createDataFrame([(x, x[0]) for x in ("a_1", "b_1", "c_1", "d_1", "b_9", "a_2", "b_2")], "gene string, species string")
    expected = spark.createDataFrame([(p, q, 4.0) for p in "abcd" for q in "abcd" if p < q], "sp_a string, sp_b string, d_exp double")
    removed = spark.createDataFrame([("f", "a_1"), ("few", "a_2")], "family string, gene string")
    out = {r.gene for r in C.pruned_families(trees, species, expected, removed, Settings(prune_criterion="absolute")).where("outlier").collect()}
    assert "a_1" in out and not out & {"a_2", "b_2", "c_1"}
    assert C.tool_outliers(trees, None).count() == 0


def test_realigned_groups_are_whole(spark, chain):
    members = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "x"), ("h", "z"), ("k", "broken")], "group string, gene string")
    proteins = spark.createDataFrame([("x", "MK"), ("y", "MKV"), ("z", "M"), ("broken", "M")], "gene string, seq string")
    cds = spark.createDataFrame([("x", "ATGAAA"), ("y", "ATGAAAGTT"), ("broken", "ATG")], "gene string, seq string")
    got = {(r.group, r.gene): r.codons for r in C.realigned(members, proteins, cds, chain.align).collect()}
    assert got == {("g", "x"): "ATGAAA---", ("g", "y"): "ATGAAAGTT"}


def test_rescue_and_adjudication(spark):
    families = spark.createDataFrame([("p", "F1"), ("q", "F2")], "gene string, family string")
    hits = spark.createDataFrame([("u1", "F1", 1e-9, 50.0), ("u1", "F2", 1e-9, 60.0), ("u2", "F1", 1e-3, 90.0), ("u3", "F9", 1e-30, 99.0), ("p", "F2", 1e-30, 9.0)], "gene string, family string, evalue double, bits double")
    found = C.rescued(spark.createDataFrame([("u1",), ("u2",), ("u3",)], "gene string"), hits, families)
    assert [(r.gene, r.family) for r in found.collect()] == [("u1", "F2")]
    assert {(r.gene, r.family) for r in C.grown(families, found).collect()} == {("q", "F2"), ("u1", "F2")}
    genes = spark.createDataFrame([("a", 300), ("b", 20), ("c", 300), ("d", 300), ("e", 300)], "gene string, length int")
    candidates = spark.createDataFrame([(g, "F1") for g in "abcde"], "gene string, family string")
    accepted = spark.createDataFrame([("a", "t", 1), ("b", "t", 1), ("c", "t", 2), ("d", "t", 3)], "gene string, reference string, edge_num int")
    edges = spark.createDataFrame([("t", 1, "F1"), ("t", 2, "F2")], "reference string, edge_num int, family string")
    assert {r.gene: r.family for r in C.adjudicated(genes, candidates, accepted, edges).collect()} == {"a": "F1", "b": None, "c": None, "d": None, "e": None}


def test_branch_tests(spark):
    rows = [("e1", "null", -100.0), ("e1", "alt", -97.0), ("e1", "alt", -95.0), ("e2", "null", -50.0), ("e2", "alt", -50.5), ("e3", "alt", -1.0), ("e4", "null", -9.0), ("e4", "alt", None)]
    got = {r.event: r for r in C.branch_tests(spark.createDataFrame(rows, "event string, hypothesis string, lnl double")).collect()}
    assert set(got) == {"e1", "e2"} and got["e1"].lnl_alt == -95 and got["e2"].p == 1
    assert abs(got["e1"].p - 0.0015654) < 1e-6 and abs(got["e1"].q - 2 * got["e1"].p) < 1e-12


def test_structures_and_caches(spark, tmp_path):
    plddt = spark.createDataFrame([("b", 20.0), ("a", 49.9), ("c", 50.0)], "gene string, plddt double")
    assert [r.gene for r in C.low_confidence(plddt).collect()] == ["a", "b"]
    atoms = spark.createDataFrame([("ok", "CA", 1, 90.0), ("ok", "CB", 1, 90.0), ("hot", "CA", 1, 120.0), ("bare", "N", 1, 5.0), ("few", "CA", 1, 5.0)], "file string, atom string, residue int, value double")
    assert {r.file: r.problem for r in C.structure_problems(atoms).collect()} == {"hot": "confidence out of range", "bare": "no atoms"}
    expected = spark.createDataFrame([("ok", 1), ("few", 2), ("gone", 7)], "file string, residues int")
    assert {r.file: r.problem for r in C.structure_problems(atoms, expected).collect()} == {"few": "residue count", "gone": "no atoms"}
    old = spark.createDataFrame([("x", 1), ("y", 2)], "gene string, v int")
    new = spark.createDataFrame([("y", 3), ("z", 4)], "gene string, v int")
    assert sorted(map(tuple, C.refreshed(old, new, "gene").collect())) == [("x", 1), ("y", 3), ("z", 4)] and C.refreshed(None, new, "gene").count() == 2
    vectors = spark.createDataFrame([("g1", [0.1, -1e-9, 3.0]), ("g2", [1 / 3])], "gene string, embedding array<double>")
    reports.write_embeddings(vectors, str(tmp_path / "e"))
    assert sorted(map(tuple, text.embeddings(spark, str(tmp_path / "e")).collect())) == sorted(map(tuple, vectors.collect()))


def test_commands_and_finished_results(spark, tmp_path):
    assert X.profile_search_command("s", "db", "f", "t", 1e-5, 32)[3:7] == ["-E", "1e-05", "--cpu", "8"]
    assert X.quoted("~/my data/x") == "~/'my data/x'" and X.quoted("a b") == "'a b'" and X.quoted("~") == "~"
    with pytest.raises(ValueError):
        X.add_queries_command("other", "b", "r", "q")
    with pytest.raises(ValueError):
        X.structure_db_command("b", "f", "db", __file__, 4)
    for k in (1, 2):
        (tmp_path / f"{k}.tbl").write_text(f"row{k}\n# [ok]\n")
    assert {r.value for r in X.whole_results(spark, str(tmp_path), 2).collect()} == {"row1", "row2", "# [ok]"}
    with pytest.raises(ValueError):
        X.whole_results(spark, str(tmp_path), 3)
    (tmp_path / "3.tbl").write_text("row3\n")
    with pytest.raises(ValueError):
        X.whole_results(spark, str(tmp_path))
    log = X.logging_to(str(tmp_path / "log" if (tmp_path / "log").mkdir() else tmp_path / "run.log"))
    assert len(X.logging_to(str(tmp_path / "run.log")).handlers) == len(log.handlers)
