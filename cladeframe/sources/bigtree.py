"""Newick trees of any size from text files: a file is read in splits, and no row or task holds a tree.

A file is cut at its commas, so each piece has one leaf: opening brackets, the leaf's label, and labels of the nodes that close
after it. Running sums of what the pieces open and close give every node its depth, preorder number and postorder number. In
the order of depth and place, the node that a bracket closes, and the parent of a node one deeper, is the last one
opened at that depth before it: one running last over all brackets finds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.sets import lookup
from cladeframe.stage import running_last, running_sums, staged

#: Fixed value: a label is a name or a support value, a length and an edge number: name:0.1{7}.
LABEL = r"^([^:{]*)(?::([^{]*))?(?:\{(\d+)\})?$"


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """tree_id (the file), block, row, text: the text between the commas of each file, in order of block and row."""
    read = spark.read.option("lineSep", ",").text(path)
    return read.select(F.col("_metadata.file_path").alias("tree_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))


def _label(text: Column) -> list[Column]:
    part = lambda n: F.trim(F.regexp_extract(text, LABEL, n))
    dist = F.nullif(part(2), F.lit(""))
    bad = ~text.rlike(LABEL) | (dist.isNotNull() & dist.try_cast("double").isNull())
    return [part(1).alias("name"), F.coalesce(dist.try_cast("double"), F.lit(0.0)).alias("dist"), part(3).try_cast("int").alias("edge_num"), bad.alias("bad")]


def tree_rows(pieces: DataFrame) -> DataFrame:
    """tree_id, node_id (preorder), parent_id, name, dist, is_leaf, depth, edge_num, postorder: a row per node of each tree.

    ValueError, with the file's name, for a text that isn't one tree ending in a semicolon. Labels can't hold commas or brackets.
    """
    body = F.regexp_replace("text", r"\s+", " ")
    heads = F.regexp_extract(body, r"^[ (]*", 0)
    parts = F.split(F.substring(body, F.length(heads) + 1, F.length(body)), r"\)")
    cut = pieces.select("tree_id", "block", "row", F.length(F.replace(heads, F.lit(" "), F.lit(""))).cast("long").alias("opens"), F.transform(parts, lambda p: F.trim(p)).alias("labels"))
    cut = cut.withColumn("closes", (F.size("labels") - 1).cast("long"))
    cut = cut.withColumns({"deeper": F.col("opens") - F.col("closes"), "nodes": F.col("opens") + 1, "ends": F.col("closes") + 1, "marks": F.col("opens") + 1 + F.col("closes")})
    order = ["tree_id", "block", "row"]
    summed = staged(running_sums(cut, order, {"d": "deeper", "n": "nodes", "q": "ends", "e": "marks"}, "newick-pieces"), "newick-sums")
    at = F.struct("block", "row")
    first = {x: F.min_by(F.col(x) - F.col(v), at).alias(f"first_{x}") for x, v in (("d", "deeper"), ("n", "nodes"), ("q", "ends"), ("e", "marks"))}
    last = F.max_by(F.element_at("labels", -1), at)
    trees = staged(summed.groupBy("tree_id").agg(*first.values(), F.max_by("d", at).alias("last_d"), last.alias("end"), F.count_if(F.array_join("labels", "").contains(";")).alias("ended")), "newick-trees")
    wrong = trees.where("last_d <> first_d OR ended <> 1 OR NOT endswith(end, ';') OR instr(end, ';') <> length(end)")
    if (bad := wrong.select("tree_id").first()) is not None:
        raise ValueError(f"not one tree: {bad.tree_id}")
    own = lookup(summed, trees.drop("last_d", "end", "ended"), ["tree_id"])
    before = {x: F.col(x) - F.col(v) - F.col(f"first_{x}") for x, v in (("d", "deeper"), ("n", "nodes"), ("q", "ends"), ("e", "marks"))}
    labels = F.transform("labels", lambda s: F.rtrim(F.replace(s, F.lit(";"), F.lit(""))))
    own = own.select("tree_id", "opens", "closes", labels.alias("labels"), *[c.alias(f"{x}0") for x, c in before.items()])
    nothing = [F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("post")]
    up_to = lambda lo, hi: F.explode(F.when(F.col(hi) >= lo, F.sequence(F.lit(lo).cast("long"), F.col(hi))).otherwise(F.array().cast("array<bigint>")))
    opened = own.where("opens > 0").withColumn("i", up_to(1, "opens")).select("tree_id", (F.col("d0") + F.col("i") - 1).alias("depth"), (F.col("e0") + F.col("i") - 1).alias("pos"), (F.col("n0") + F.col("i") - 1).alias("id"))
    leaf = own.select("tree_id", (F.col("d0") + F.col("opens")).alias("depth"), (F.col("e0") + F.col("opens")).alias("pos"), (F.col("n0") + F.col("opens")).alias("id"), F.get("labels", F.lit(0)).alias("label"), F.col("q0").alias("post"))
    closed = own.where("closes > 0").withColumn("j", up_to(1, "closes"))
    closed = closed.select("tree_id", (F.col("d0") + F.col("opens") - F.col("j")).alias("depth"), (F.col("e0") + F.col("opens") + F.col("j")).alias("pos"), F.get("labels", F.col("j").cast("int")).alias("label"), (F.col("q0") + F.col("j")).alias("post"))
    none = F.lit(None).cast("long")
    rows = opened.select("tree_id", F.col("depth").alias("key"), "pos", F.lit("open").alias("kind"), "id", *nothing)
    rows = rows.unionByName(opened.select("tree_id", (F.col("depth") - 1).alias("key"), "pos", F.lit("child").alias("kind"), "id", *nothing).where("key >= 0"))
    rows = rows.unionByName(leaf.select("tree_id", (F.col("depth") - 1).alias("key"), "pos", F.lit("leaf").alias("kind"), "id", "label", "post"))
    rows = rows.unionByName(closed.select("tree_id", F.col("depth").alias("key"), "pos", F.lit("close").alias("kind"), none.alias("id"), "label", "post"))
    open_ = F.when(F.col("kind") == "open", F.struct("tree_id", "key", "id"))
    found = staged(running_last(rows, ["tree_id", "key", "pos", "kind"], open_, "up", "newick-brackets"), "newick-found")
    found = found.withColumn("to", F.when((F.col("up.tree_id") == F.col("tree_id")) & (F.col("up.key") == F.col("key")), F.col("up.id")))
    # A tree has one node at the top, and no bracket closes what isn't open.
    tops = found.groupBy("tree_id").agg(F.count_if(F.expr("(kind = 'open' AND key = 0) OR (kind = 'leaf' AND key = -1)")).alias("tops"), F.count_if(F.expr("key < -1 OR (to IS NULL AND NOT (kind = 'leaf' AND key = -1))")).alias("lost"))
    if (bad := tops.where("tops <> 1 OR lost > 0").select("tree_id").first()) is not None:
        raise ValueError(f"not one tree: {bad.tree_id}")
    shut = found.where("kind = 'close'").select("tree_id", F.col("to").alias("node_id"), none.alias("parent_id"), "label", "post", F.col("key").alias("depth"), F.lit(False).alias("is_leaf"))
    inner = found.where("kind = 'child'").select("tree_id", F.col("id").alias("node_id"), F.col("to").alias("parent_id"), *nothing, (F.col("key") + 1).alias("depth"), F.lit(False).alias("is_leaf"))
    tips = found.where("kind = 'leaf'").select("tree_id", F.col("id").alias("node_id"), F.col("to").alias("parent_id"), "label", "post", (F.col("key") + 1).alias("depth"), F.lit(True).alias("is_leaf"))
    both = shut.unionByName(inner).groupBy("tree_id", "node_id").agg(*[F.max(c).alias(c) for c in ("parent_id", "label", "post", "depth", "is_leaf")])
    said = staged(both.unionByName(tips.select(both.columns)).select("tree_id", "node_id", "parent_id", *_label(F.col("label")), "is_leaf", "depth", F.col("post").alias("postorder")), "newick-nodes")
    if (bad := said.where("bad OR (is_leaf AND name = '')").select("tree_id").first()) is not None:
        raise ValueError(f"bad label: {bad.tree_id}")
    return said.select("tree_id", "node_id", "parent_id", "name", "dist", "is_leaf", "depth", "edge_num", "postorder")
