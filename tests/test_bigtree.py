"""Trees read in splits of a file against the parser of one text."""

import random

import pytest

from cladeframe.operators import forest as W
from cladeframe.sources import bigtree as B
from cladeframe.sources import newick as N
from cladeframe.stage import running_last


def random_text(r, n, ladder=False):
    parts = [f"sp{i}_g{r.randrange(99)}:{r.randrange(1, 90) / 10}" for i in range(n)]
    while len(parts) > 1:
        k = min(len(parts), r.choice([2, 2, 2, 3, 5]))
        at = 0 if ladder else r.randrange(len(parts) - k + 1)
        label = r.choice(["", "0.9", "clade x"]) + r.choice(["", ":1e-05", ":0.25"]) + r.choice(["", "", "{%d}" % r.randrange(50)])
        parts[at : at + k] = ["(" + r.choice([",", ", ", ",\n"]).join(parts[at : at + k]) + ")" + label]
    return parts[0] + ";" + r.choice(["", "\n"])


def plain(nodes):
    return {n["node_id"]: (n["parent_id"], n["name"], n["dist"], n["is_leaf"], n["depth"], n["edge_num"], n["postorder"]) for n in nodes}


def read(spark, path):
    out = {}
    for r in B.tree_rows(B.pieces(spark, str(path))).collect():
        out.setdefault(r.tree_id.rsplit("/", 1)[1], {})[r.node_id] = (r.parent_id, r.name, r.dist, r.is_leaf, r.depth, r.edge_num, r.postorder)
    return out


def test_many_trees_as_one_text_each(spark, tmp_path):
    r = random.Random(1)
    texts = {f"t{i}.nwk": random_text(r, r.choice([2, 3, 40, 200]), r.random() < 0.3) for i in range(6)}
    texts["one.nwk"] = "alone:3;"
    texts["deep.nwk"] = "(" * 300 + "a" + "".join(f",b{i}):0.5" for i in range(300)) + ";"
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    assert read(spark, tmp_path) == {name: plain(N.parse(text)) for name, text in texts.items()}


def test_a_large_tree_in_many_splits(spark, tmp_path):
    text = random_text(random.Random(2), 20000)
    (tmp_path / "big.nwk").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert B.pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        assert read(spark, tmp_path) == {"big.nwk": plain(N.parse(text))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["((a,b);", "(a,b));", "(a,b);x", "(a,b)", "(a,);", "(a b:x,c);", "a,b;", "(a,b),c;", "(a,(b),c));(", "(a,b;,c);", ""])
def test_texts_that_are_no_tree(spark, tmp_path, text):
    (tmp_path / "bad.nwk").write_text(text)
    if text:
        with pytest.raises(ValueError, match="bad.nwk"):
            B.tree_rows(B.pieces(spark, str(tmp_path)))
    else:
        assert B.tree_rows(B.pieces(spark, str(tmp_path))).count() == 0


def test_places_and_pairs_of_a_file(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((fern:1,moss:2)x:3,(reed:4,rush:5)y:6);")
    nodes = B.tree_rows(B.pieces(spark, str(tmp_path)))
    name = {r.name: (r.tree_id, r.node_id) for r in nodes.collect()}
    asked = spark.createDataFrame([(name["fern"][0], name["fern"][1], name["rush"][1]), (name["fern"][0], name["fern"][1], name["moss"][1])], "tree_id string, a long, b long")
    got = {(r.a, r.b): r.distance for r in W.lowest_common(W.jump_table(nodes, "dist"), asked).collect()}
    assert got == {(name["fern"][1], name["rush"][1]): 15.0, (name["fern"][1], name["moss"][1]): 3.0}


def test_the_last_value_across_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(i, i if i in (3, 4, 700) else None) for i in range(1000)]
    got = {r.k: r.last for r in running_last(spark.createDataFrame(rows, "k int, v int").repartition(5), ["k"], F.col("v"), "last", "lasts").collect()}
    assert got == {i: None if i < 3 else 3 if i == 3 else 4 if i < 700 else 700 for i in range(1000)}
