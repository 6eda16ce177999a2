"""Trees of any depth and size as tables: places by doubling, asked pairs by lifting, parsimony by contraction.

Nodes are rows (tree_id, node_id, parent_id, ...); nothing here holds a tree, a path or a group of leaves in one row or task,
and rounds grow with the logarithm of the depth or the number of nodes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.operators.sets import lookup
from cladeframe.stage import staged

NODE = ["tree_id", "node_id"]


def jump_table(nodes: DataFrame, dist: str | None = None) -> list[DataFrame]:
    """By level, tree_id, node_id, top, steps, length: each node's ancestor 2**level steps up, or its root if that is nearer.

    length is the sum of dist (1 where no column is named) over the branches passed. The last level has every node's depth
    as steps and the root as top. ValueError if rows form a cycle or a parent isn't a node.
    """
    own = F.col(dist).cast("double") if dist else F.lit(1.0)
    is_root = F.col("parent_id").isNull()
    base = nodes.select(*NODE, F.coalesce("parent_id", "node_id").alias("top"), F.when(is_root, 0).otherwise(1).cast("long").alias("steps"), F.when(is_root, 0.0).otherwise(own).alias("length"))
    now = staged(base, "jumps")
    n = now.count()
    levels = [now]
    while True:
        level = len(levels) - 1
        # Nodes whose pointer has not reached a root: 2**level steps lie between them.
        open_ = now.where(F.col("steps") == 1 << level)
        if open_.isEmpty():
            return levels
        if 1 << level > n:
            raise ValueError("the tree has a cycle")
        above = now.select("tree_id", F.col("node_id").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"), F.col("length").alias("_length"))
        moved = lookup(open_, above, ["tree_id", "top"]).select(*NODE, F.col("_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("length") + F.col("_length")).alias("length"))
        now = staged(now.where(F.col("steps") < 1 << level).unionByName(moved), "jumps")
        if level == 0 and now.count() != n:
            raise ValueError("a parent is not a node of the tree")
        levels.append(now)


def places(jumps: list[DataFrame]) -> DataFrame:
    """tree_id, node_id, root_id, depth, root_dist (from the root, its own branch left out) of a jump table."""
    return jumps[-1].select(*NODE, F.col("top").alias("root_id"), F.col("steps").alias("depth"), F.col("length").alias("root_dist"))


def lowest_common(jumps: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """pairs (tree_id, a, b) with lca, lca_depth, steps and distance: of nodes asked for, and of no others.

    The deeper node of a pair is lifted by the bits of their difference in depth, then both by falling powers of two while
    they differ; the next node up is shared. Each step is a lookup of the asked pairs that move. A pair with an unknown node,
    or of two trees with one id, has nulls; repeated pairs are repeated.
    """
    top_level = len(jumps) - 1
    at = places(jumps)
    one = lambda k: at.select("tree_id", F.col("node_id").alias(k), F.col("root_id").alias(f"_root_{k}"), F.col("depth").alias(f"_depth_{k}"), F.col("root_dist").alias(f"_dist_{k}"))
    asked = staged(pairs.select("tree_id", "a", "b").distinct(), "asked")
    known = lookup(staged(lookup(asked, one("a"), ["tree_id", "a"]), "asked"), one("b"), ["tree_id", "b"]).where("_root_a = _root_b")
    a_deeper = F.col("_depth_a") >= F.col("_depth_b")
    now = known.withColumns({"x": F.when(a_deeper, F.col("a")).otherwise(F.col("b")), "y": F.when(a_deeper, F.col("b")).otherwise(F.col("a")), "_more": F.abs(F.col("_depth_a") - F.col("_depth_b"))})
    now = staged(now, "lifted")

    def tops(level: int, node: str, top: str) -> DataFrame:
        return jumps[level].select("tree_id", F.col("node_id").alias(node), F.col("top").alias(top))

    for level in range(top_level, -1, -1):
        moves = now.where(F.col("_more").bitwiseAND(F.lit(1 << level)) != 0)
        if moves.isEmpty():
            continue
        moved = lookup(moves, tops(level, "x", "_up"), ["tree_id", "x"]).withColumn("x", F.col("_up")).drop("_up")
        now = staged(now.where(F.col("_more").bitwiseAND(F.lit(1 << level)) == 0).unionByName(moved), "lifted")
    for level in range(top_level, -1, -1):
        # Pairs that are apart; where their pointers fall together, the shared node is lower or there.
        apart = now.where("x <> y")
        if apart.isEmpty():
            break
        up = lookup(staged(lookup(apart, tops(level, "x", "_ux"), ["tree_id", "x"]), "lifted"), tops(level, "y", "_uy"), ["tree_id", "y"])
        moved = up.withColumns({"x": F.when(F.col("_ux") != F.col("_uy"), F.col("_ux")).otherwise(F.col("x")), "y": F.when(F.col("_ux") != F.col("_uy"), F.col("_uy")).otherwise(F.col("y"))}).drop("_ux", "_uy")
        now = staged(now.where("x = y").unionByName(moved), "lifted")
    apart = lookup(now.where("x <> y"), tops(0, "x", "lca"), ["tree_id", "x"])
    met = staged(now.where("x = y").withColumn("lca", F.col("x")).unionByName(apart), "lifted")
    lca = at.select("tree_id", F.col("node_id").alias("lca"), F.col("depth").alias("lca_depth"), F.col("root_dist").alias("_lca_dist"))
    found = lookup(met, lca, ["tree_id", "lca"]).select(
        "tree_id",
        "a",
        "b",
        "lca",
        "lca_depth",
        (F.col("_depth_a") + F.col("_depth_b") - 2 * F.col("lca_depth")).alias("steps"),
        (F.col("_dist_a") + F.col("_dist_b") - 2 * F.col("_lca_dist")).alias("distance"),
    )
    return pairs.join(found, ["tree_id", "a", "b"], "left")


#: States of one tree at most: a set of them is the bits of a long.
MOST_STATES = 62
EVERY = -1
#: A tree ends within some two rounds per doubling of its nodes; rows that don't form trees never do.
MOST_ROUNDS = 200

# A set function says what set a node gets from the set of its one child that isn't known yet. As a list of longs: the result for
# an empty set, then pieces (test, add, keep), of which the first whose test shares a state with the set x gives
# add | (x & keep); the last one's test is EVERY. Of each other piece, keep is within test, so a composition of two is such
# a list again, and as pieces that earlier tests cover are left out, it has at most one piece more than there are states.


def applied(function: list[int], x: int) -> int:
    if not x:
        return function[0]
    for i in range(1, len(function), 3):
        test, add, keep = function[i : i + 3]
        if x & test:
            return add | (x & keep)
    raise ValueError("a set function ends with a piece for every set")


def composed(outer: list[int], inner: list[int]) -> list[int]:
    """The function that gives outer of inner."""
    out, seen = [applied(outer, inner[0])], 0
    for i in range(1, len(inner), 3):
        test1, add1, keep1 = inner[i : i + 3]
        for j in range(1, len(outer), 3):
            test2, add2, keep2 = outer[j : j + 3]
            sure = test2 == EVERY or add1 & test2  # the inner result is never empty here
            test = test1 if sure else keep1 & test2
            if test & ~seen:
                out += [test, add2 | (add1 & keep2), keep1 & keep2]
                seen |= test
            if sure:
                break
        if seen == EVERY:
            break
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _composed(outer: pd.Series, inner: pd.Series) -> pd.Series:
    return pd.Series([composed([int(v) for v in f], [int(v) for v in g]) for f, g in zip(outer, inner, strict=True)])


def _applied(function: Column, x: Column) -> Column:
    pieces = F.transform(F.sequence(F.lit(1), ((F.size(function) - 1) / 3).cast("int")), lambda i: F.struct(F.get(function, i * 3 - 2).alias("t"), F.get(function, i * 3 - 1).alias("a"), F.get(function, i * 3).alias("k")))
    first = F.get(F.filter(pieces, lambda p: p["t"].bitwiseAND(x) != 0), F.lit(0))
    return F.when(x == 0, F.get(function, F.lit(0))).otherwise(first["a"].bitwiseOR(x.bitwiseAND(first["k"])))


def _longs(*values: Column) -> Column:
    return F.array(*[v.cast("long") for v in values])


def parsimony_sets(indexed: DataFrame) -> DataFrame:
    """idx, set: parsimony sets of all nodes, as bits. indexed: idx, parent (both longs), is_leaf, own (a leaf's bits), staged.

    Rake: known sets are folded into their parents; a node all of whose children are known is known. Compress: a node with
    one unknown child is a set function of it, and functions along such a chain are composed in pairs, so a chain
    halves each round. Both together end within a number of rounds that grows with the logarithm of the nodes. What was folded
    in and that no chain ends at leaves the table.
    """
    children = indexed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("idx")).agg(F.count("*").alias("pending"), F.bit_xor("idx").alias("rest"))
    known = F.col("is_leaf")
    none = F.lit(None).cast("long")
    start = indexed.join(children, "idx", "left").select(
        "idx",
        "parent",
        F.coalesce("pending", F.lit(0)).alias("pending"),
        F.coalesce("rest", F.lit(0)).cast("long").alias("rest"),
        F.lit(EVERY).cast("long").alias("shared"),
        F.lit(0).cast("long").alias("any"),
        F.when(known, F.coalesce("own", F.lit(0))).cast("long").alias("set"),
        none.alias("target"),
        F.lit(None).cast("array<bigint>").alias("f"),
        F.when(known, 0).cast("int").alias("age"),
    )
    live = staged(start, "rake")
    done: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        if live.where("set IS NULL").isEmpty():
            done.append(live.select("idx", "set"))
            break
        # A known node that was told to its parent goes unless the end of a chain rests on it.
        old, asked = live.where("age >= 1"), live.where("set IS NULL AND f IS NOT NULL").select(F.col("target").alias("idx")).distinct()
        done.append(old.join(asked, "idx", "left_anti").select("idx", "set"))
        live = live.where("age IS NULL OR age = 0").unionByName(old.join(asked, "idx", "left_semi"))
        told = live.where("age = 0 AND parent IS NOT NULL")
        votes = F.col("set") != 0
        into = told.groupBy(F.col("parent").alias("idx")).agg(F.count("*").alias("_c"), F.bit_xor("idx").alias("_x"), F.bit_and(F.when(votes, F.col("set"))).alias("_i"), F.bit_or("set").alias("_u"))
        got = live.join(into, "idx", "left").withColumns(
            {
                "pending": F.col("pending") - F.coalesce("_c", F.lit(0)),
                "rest": F.col("rest").bitwiseXOR(F.coalesce("_x", F.lit(0))),
                "shared": F.col("shared").bitwiseAND(F.coalesce("_i", F.lit(EVERY))),
                "any": F.col("any").bitwiseOR(F.coalesce("_u", F.lit(0))),
                "age": F.col("age") + 1,
            }
        )
        best = F.when(F.col("any") == 0, F.lit(0)).when(F.col("shared") != 0, F.col("shared")).otherwise(F.col("any"))
        ends = F.col("set").isNull() & (F.col("pending") == 0)
        became = F.col("set").isNull() & (F.col("pending") == 1) & F.col("f").isNull()
        every, zero = F.lit(EVERY), F.lit(0)
        function = (
            F.when(F.col("any") == 0, _longs(zero, every, zero, every))
            .when(F.col("shared") != 0, _longs(F.col("shared"), F.col("shared"), zero, F.col("shared"), every, F.col("any"), every))
            .otherwise(_longs(F.col("any"), every, F.col("any"), every))
        )
        raked = got.select(
            "idx",
            "parent",
            "pending",
            "rest",
            "shared",
            "any",
            F.when(ends, best).otherwise(F.col("set")).cast("long").alias("set"),
            F.when(became, F.col("rest")).otherwise(F.col("target")).alias("target"),
            F.when(became, function).otherwise(F.col("f")).alias("f"),
            F.when(ends, F.lit(0)).otherwise(F.col("age")).cast("int").alias("age"),
        )
        live = staged(raked, "rake")
        chain = live.where("set IS NULL AND f IS NOT NULL")
        if chain.isEmpty():
            continue
        at = live.select(F.col("idx").alias("target"), F.col("set").alias("_set"), F.col("target").alias("_target"), F.col("f").alias("_f")).where("_set IS NOT NULL OR _f IS NOT NULL")
        # Targets that are neither known nor in a chain stay as they are.
        wait = chain.join(at.select("target"), "target", "left_anti")
        met = staged(lookup(chain, at, ["target"]), "compress")
        ready = met.where("_set IS NOT NULL").withColumns({"set": _applied(F.col("f"), F.col("_set")), "age": F.lit(0)})
        linked = met.where("_set IS NULL").withColumns({"f": _composed("f", "_f"), "target": F.col("_target")})
        names = live.columns
        rest = live.where("NOT (set IS NULL AND f IS NOT NULL)")
        live = staged(rest.unionByName(wait.select(names)).unionByName(ready.select(names)).unionByName(linked.select(names)), "compress")
    else:
        raise ValueError("the tree has a cycle")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def parsimony(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """tree_id, node_id, state: Fitch's parsimony for a forest of trees of any depth and number of children.

    nodes: tree_id, node_id, parent_id, name, is_leaf. states: name, state, and tree_id where they differ by tree; a null or absent
    state doesn't vote. Going up, the sets of children that aren't empty are intersected, or united if nothing is shared. Going
    down, a parent's state stays where it can, else the first in order is taken; a leaf without a state has none. The way
    down is a map from a parent's state to one's own, doubled along the paths. ValueError for a tree of more than 62 states.
    """
    own = ["tree_id", "name"] if "tree_id" in states.columns else ["name"]
    said = states.where("state IS NOT NULL").select(*own, "state").distinct()
    base = staged(nodes.select(*NODE, "parent_id", "name", "is_leaf").withColumn("idx", F.monotonically_increasing_id()), "fitch-nodes")
    tips = staged(base.where("is_leaf").join(said, own), "fitch-tips").select("tree_id", "idx", "state")
    # At most MOST_STATES rows a tree go on.
    order = Window.partitionBy("tree_id").orderBy("state")
    ranks = staged(tips.select("tree_id", "state").distinct().withColumn("bit", F.row_number().over(order)).where(F.col("bit") <= MOST_STATES + 1), "fitch-bits")
    most = ranks.agg(F.max("bit")).first()[0] or 0
    if most > MOST_STATES:
        raise ValueError(f"a tree has more than {MOST_STATES} states")
    bits = lookup(tips, ranks, ["tree_id", "state"]).groupBy("idx").agg(F.min("bit").alias("bit"))
    parents = base.select("tree_id", F.col("node_id").alias("parent_id"), F.col("idx").alias("parent"))
    linked = lookup(base.where("parent_id IS NOT NULL"), parents, ["tree_id", "parent_id"]).select("tree_id", "idx", "parent", "is_leaf")
    roots = base.where("parent_id IS NULL").select("tree_id", "idx", F.lit(None).cast("long").alias("parent"), "is_leaf")
    indexed = linked.unionByName(roots).join(bits, "idx", "left").withColumn("own", F.expr("shiftleft(1L, bit - 1)")).drop("bit")
    indexed = staged(indexed, "fitch-indexed")
    if indexed.count() != base.count():
        raise ValueError("a parent is not a node of the tree")
    sets = parsimony_sets(indexed.drop("tree_id"))
    # Bits run from 1; 0 is no state.
    lowest = F.when(F.col("set") == 0, F.lit(0)).otherwise(F.expr("bit_count((set & -set) - 1) + 1")).cast("int")
    n = F.lit(most)
    inside = lambda p: F.col("set").bitwiseAND(F.pow(F.lit(2.0), (p - 1).cast("double")).cast("long")) != 0
    step = F.transform(F.sequence(F.lit(0), n), lambda p: F.when((p > 0) & inside(p), p).when(F.col("set") != 0, lowest).when(F.col("is_leaf"), F.lit(0)).otherwise(p).cast("int"))
    joined = indexed.join(sets, "idx")
    now = joined.select("tree_id", "idx", F.col("parent").alias("top"), F.when(F.col("parent").isNull(), lowest).alias("at"), F.when(F.col("parent").isNotNull(), step).alias("map"))
    now = staged(now, "fitch-down")
    while not (open_ := now.where("at IS NULL")).isEmpty():
        above = now.select(F.col("idx").alias("top"), F.col("top").alias("_top"), F.col("at").alias("_at"), F.col("map").alias("_map"))
        met = lookup(open_, above, ["top"])
        met = met.select("tree_id", "idx", F.col("_top").alias("top"), F.when(F.col("_at").isNotNull(), F.get("map", F.col("_at"))).alias("at"), F.when(F.col("_at").isNull(), F.transform("_map", lambda p: F.get("map", p))).alias("map"))
        now = staged(now.where("at IS NOT NULL").unionByName(met), "fitch-down")
    named = now.select("tree_id", "idx", F.col("at").alias("bit")).join(F.broadcast(ranks) if ranks.count() <= 1_000_000 else ranks, ["tree_id", "bit"], "left")
    return base.select(*NODE, "idx").join(named.select("idx", "state"), "idx").select(*NODE, "state")
