"""Connected components of a graph in Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import staged


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """For edges (a, b) of longs: (node, component) for every node that has an edge, component the smallest reachable node.

    Only aggregates and joins on the edges; nothing reaches the driver but two numbers a round. A node of
    very many edges costs a partial aggregate in each task, and its rows in the join can be split, as
    both sides are plain columns. Loops and repeated edges are fine. Each round is staged.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = staged(both, "edges")
    before = None
    for _ in range(most_rounds):
        # Large star: every greater neighbour of a node is linked to its smallest neighbour (or itself).
        links = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        star = large.join(low, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        now = staged(star, "edges")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")).first()
        if before == (row["n"], row["h"]):
            break
        before = (row["n"], row["h"])
    else:
        raise RuntimeError("components did not settle")
    ends = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return ends.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
