import pytest
from pyspark.sql import functions as F

from cladeframe.functions import exprs as X
from cladeframe.functions import ids as I


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("Zmon_g1", "Zmon"), ("a_b_c", "a"), ("plain", "plain")])
def test_species(spark, given, want):
    assert one(spark, I.species_of(F.lit(given))) == want


def test_canonical_is_idempotent(spark):
    for given, want in ((" Zmon_g1.t1.pdb ", "Zmon_g1_t1"), ("x.fa", "x"), ("x.fa.pdb", "x_fa"), ("a.b.c", "a_b_c")):
        got = one(spark, I.canonical(F.lit(given)))
        assert got == want and one(spark, I.canonical(F.lit(got))) == got


def test_suffixes(spark):
    assert [one(spark, I.without_isoform(F.lit(x))) for x in ("g1.t2", "g1_t2", "g1.3", "g_3", "g.t1.t2")] == ["g1", "g1", "g1", "g_3", "g.t1"]
    assert one(spark, I.without_transcript(F.lit("AT4G77001.6"))) == "AT4G77001"
    assert one(spark, I.target_family(F.lit("R1_OG1.pdb.gz"))) == "R1_OG1"
    assert one(spark, I.accession(F.lit("AF-Q8ZZK4-3-F1-model_v2"))) == "Q8ZZK4" and one(spark, I.accession(F.lit("AF-B2WQX7-F1-model_v3"))) == "B2WQX7"
    with pytest.raises(Exception, match="no accession"):
        one(spark, I.accession(F.lit("nothing")))


def test_paths_and_regions(spark):
    assert one(spark, I.orthogroup_path("run", F.lit("R7_OG0000318"))) == "run/round_07/orthogroups/OG0000318"
    with pytest.raises(Exception, match="no round"):
        one(spark, I.orthogroup_path("run", F.lit("OG1")))
    assert tuple(one(spark, I.region_bounds(F.lit("3-17")))) == (3, 17)


def test_first_spelling_that_matches(spark):
    index = spark.createDataFrame([("Zmon_g1", "F1"), ("Zmon_g3.t1", "F2")], "id string, family string")
    asked = spark.createDataFrame([("g1", "Zmon"), ("g3", "Zmon"), ("Zmon_g1.1", "Zmon"), ("zzz", "Zmon")], "gene string, sp string")
    got = {r.gene: (r.matched, r.family) for r in I.first_match(asked, "gene", index, "id", "sp").collect()}
    assert got == {"g1": ("Zmon_g1", "F1"), "g3": ("Zmon_g3.t1", "F2"), "Zmon_g1.1": ("Zmon_g1", "F1"), "zzz": (None, None)}


def test_levels_of_matching(spark):
    ref = spark.createDataFrame([("a.1",), ("b",)], "id string")
    ask = lambda *xs: spark.createDataFrame([(x,) for x in xs], "q string")
    assert I.matched_ids(ask("a.1", "b"), "q", ref, "id")[1:] == ("exact", 0.0)
    assert I.matched_ids(ask("a_1", "b"), "q", ref, "id")[1:] == ("canonical", 0.0)
    out, level, share = I.matched_ids(ask("a_t1", "nope"), "q", ref.union(ask("a")), "id")
    assert level == "isoform" and share == 0.5
    with pytest.raises(ValueError, match="no match"):
        I.matched_ids(ask("nope"), "q", ref, "id", max_unmatched=0.1)
    with pytest.raises(Exception, match="collide"):
        I.index_of(ask("a.1", "a_1"), "q", I.canonical).collect()


def test_numbers(spark):
    spans = lambda *xs: F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in xs])
    assert one(spark, X.merged_length(spans((1, 60), (41, 100)))) == 100 and one(spark, X.merged_length(spans((5, 9), (1, 2), (6, 7)))) == 7
    assert one(spark, X.coverage(spans((1, 50), (45, 80)), F.lit(200))) == 0.4 and one(spark, X.coverage(spans((1, 5)), F.lit(0))) == 0.0
    vec = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, X.cosine(vec(1.0, 0.0), vec(1.0, 1.0))) == pytest.approx(0.70710678) and one(spark, X.cosine(vec(0.0, 0.0), vec(1.0, 1.0))) == 0
    with pytest.raises(Exception, match="different sizes"):
        one(spark, X.cosine(vec(1.0), vec(1.0, 1.0)))
    assert one(spark, X.min_support(F.lit("0.98/87"))) == 0.98 and one(spark, X.min_support(F.lit("name"))) is None
    assert one(spark, X.lrt_pvalue(F.lit(-10.0), F.lit(-12.0))) == pytest.approx(0.0455, abs=1e-4) and one(spark, X.lrt_pvalue(F.lit(-12.0), F.lit(-10.0))) == 1.0
    assert one(spark, X.fold_seconds(F.lit(210))) == pytest.approx(1.68) and one(spark, X.fold_seconds(F.lit(2000), 1100)) == 0
    assert one(spark, X.margin_required(F.lit(1000.0))) == 50 and one(spark, X.margin_required(F.lit(100.0))) == 10


def test_locations(spark):
    probs = F.create_map(F.lit("Plastid"), F.lit(0.45), F.lit("Cytoplasm"), F.lit(0.44), F.lit("Other"), F.lit(0.11))
    assert one(spark, X.top_location(F.lit("x"), probs)) is None and one(spark, X.top_location(F.lit("x"), probs, 0.4)) == "Plastid"
    assert one(spark, X.top_location(F.lit("Plastid"), F.lit(None).cast("map<string,double>"))) == "Plastid"


def test_group_order(spark):
    df = spark.createDataFrame([("10",), ("b",), ("9",), ("a",)], "g string")
    assert [r.g for r in df.orderBy(*X.group_order(F.col("g"))).collect()] == ["9", "10", "a", "b"]
