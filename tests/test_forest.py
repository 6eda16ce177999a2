"""Jump tables, asked pairs and parsimony by contraction against plain Python on random and very deep trees."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import forest as W
from cladeframe.operators import trees as T

NODES = "tree_id string, node_id string, parent_id string, name string, dist double, is_leaf boolean"


def random_tree(r, tree, n, kind):
    """Rows of a tree of n nodes: kind 'bushy', 'ladder' or 'any'."""
    parent = {0: None}
    for i in range(1, n):
        parent[i] = max(0, i - r.choice([1, 1, 1, 2])) if kind == "ladder" else r.randrange(max(0, i - 4), i) if kind == "any" else r.randrange(i)
    inner = {p for p in parent.values() if p is not None}
    name = lambda i: f"{tree}.{i}"
    return [(tree, name(i), None if p is None else name(p), f"leaf{i}" if i not in inner else "", float(1 + i % 3), i not in inner) for i, p in parent.items()]


def paths(rows):
    up = {(t, i): (p, d) for t, i, p, _, d, _ in rows}
    out = {}
    for t, i, *_ in rows:
        path, at = [], i
        while at is not None:
            p, d = up[t, at]
            path.append((at, d))
            at = p
        out[t, i] = path  # from the node to the root
    return out


def fitch(rows, state):
    """State by (tree, node), from the definition. state: by (tree, leaf name)."""
    below, by = defaultdict(list), {(t, i): (p, n, leaf) for t, i, p, n, _, leaf in rows}
    for t, i, p, *_ in rows:
        if p is not None:
            below[t, p].append((t, i))
    depth = {k: len(v) for k, v in paths(rows).items()}
    sets, out = {}, {}
    for k in sorted(by, key=depth.get, reverse=True):
        if by[k][2]:
            s = state.get((k[0], by[k][1]))
            sets[k] = set() if s is None else {s}
        else:
            votes = [sets[c] for c in below[k] if sets[c]]
            sets[k] = (set.intersection(*votes) or set.union(*votes)) if votes else set()
    for k in sorted(by, key=depth.get):
        above = out.get((k[0], by[k][0]))
        if sets[k]:
            out[k] = above if above in sets[k] else min(sets[k])
        else:
            out[k] = None if by[k][2] else above
    return out


def forest(seed):
    r = random.Random(seed)
    rows = [("one", "one.0", None, "leaf0", 2.0, True)]
    for t, (n, kind) in enumerate([(2, "any"), (40, "bushy"), (60, "any"), (90, "ladder"), (30, "ladder"), (25, "bushy")]):
        rows += random_tree(r, f"t{t}", n, kind)
    return r, rows


def test_places_and_jumps(spark):
    _, rows = forest(1)
    jumps = W.jump_table(spark.createDataFrame(rows, NODES).repartition(3), "dist")
    way = paths(rows)
    got = {(x.tree_id, x.node_id): (x.root_id, x.depth, x.root_dist) for x in W.places(jumps).collect()}
    assert got == {k: (p[-1][0], len(p) - 1, sum(d for _, d in p[:-1])) for k, p in way.items()}
    level = {(x.tree_id, x.node_id): (x.top, x.steps) for x in jumps[3].collect()}
    assert level == {k: (p[min(8, len(p) - 1)][0], min(8, len(p) - 1)) for k, p in way.items()}


def lca(way, t, a, b):
    pa, pb = way[t, a], way[t, b]
    shared = {n for n, _ in pa} & {n for n, _ in pb}
    top = next(n for n, _ in pa if n in shared)
    up = lambda p: sum(d for _, d in p[: [n for n, _ in p].index(top)])
    return top, len(way[t, top]) - 1, up(pa) + up(pb)


@pytest.mark.parametrize("broadcast", [True, False])
def test_asked_pairs(spark, monkeypatch, broadcast):
    from cladeframe.operators import sets as S

    if not broadcast:
        monkeypatch.setattr(S, "BROADCAST_ROWS", 5)
    r, rows = forest(2)
    way = paths(rows)
    ids = defaultdict(list)
    for t, i, *_ in rows:
        ids[t].append(i)
    asked = [(t, r.choice(ids[t]), r.choice(ids[t]), k) for k, t in enumerate(r.choices(sorted(ids), k=80))]
    asked += [("t2", "t2.0", x, -1) for x in ids["t2"]] + [("t2", "t2.3", "nobody", -2), ("t2", "t2.1", "t3.1", -3), (None, "t2.1", "t2.1", -4), asked[0]]
    jumps = W.jump_table(spark.createDataFrame(rows, NODES), "dist")
    got = W.lowest_common(jumps, spark.createDataFrame(asked, "tree_id string, a string, b string, k int")).collect()
    assert len(got) == len(asked)
    for x in got:
        if x.k < -1:
            assert x.lca is None and x.distance is None
        else:
            assert (x.lca, x.lca_depth, x.distance) == lca(way, x.tree_id, x.a, x.b), x


def test_a_tree_two_thousand_deep(spark):
    n = 2000
    rows = [("t", str(i), str(i - 1) if i else None, f"leaf{i}" if i == n else "", 1.0, i == n) for i in range(n + 1)] + [("t", f"s{i}", str(i), f"side{i}", 0.5, True) for i in range(n)]
    nodes = spark.createDataFrame(rows, NODES)
    jumps = W.jump_table(nodes, "dist")
    assert len(jumps) <= 12
    asked = spark.createDataFrame([("t", f"s{i}", f"s{j}") for i, j in ((0, 1999), (5, 1000), (7, 7), (1500, 1501))], "tree_id string, a string, b string")
    got = {(x.a, x.b): (x.lca, x.distance) for x in W.lowest_common(jumps, asked).collect()}
    assert got == {("s0", "s1999"): ("0", 2000.0), ("s5", "s1000"): ("5", 996.0), ("s7", "s7"): ("s7", 0.0), ("s1500", "s1501"): ("1500", 2.0)}


@pytest.mark.parametrize("seed", [3, 4])
def test_parsimony_of_random_forests(spark, seed):
    r, rows = forest(seed)
    state = {(t, n): r.choice("abcd" if seed == 3 else "ab") for t, _, _, n, _, leaf in rows if leaf and r.random() < 0.8}
    states = spark.createDataFrame([(t, n, s) for (t, n), s in state.items()] + [("t1", "leaf9", None), ("nowhere", "leaf1", "a")], "tree_id string, name string, state string")
    got = {(x.tree_id, x.node_id): x.state for x in W.parsimony(spark.createDataFrame(rows, NODES).repartition(3), states).collect()}
    assert got == fitch(rows, state)


def test_parsimony_of_a_ladder_takes_few_rounds(spark, monkeypatch):
    n, r = 2000, random.Random(5)
    rows = [("t", str(i), str(i - 1) if i else None, "", 1.0, False) for i in range(n)] + [("t", f"s{i}", str(i), f"side{i}", 1.0, True) for i in range(n)] + [("t", "end", str(n - 1), "end", 1.0, True)]
    state = {("t", x[3]): r.choice("abc") for x in rows if x[5] and r.random() < 0.9}
    states = spark.createDataFrame([(n_, s) for (_, n_), s in state.items()], "name string, state string")
    rounds = []
    kept = W.staged
    monkeypatch.setattr(W, "staged", lambda df, tag, *a: (rounds.append(tag), kept(df, tag, *a))[1])
    got = {(x.tree_id, x.node_id): x.state for x in W.parsimony(spark.createDataFrame(rows, NODES), states).collect()}
    assert got == fitch(rows, state)
    assert rounds.count("rake") + rounds.count("fitch-down") < 30, "a round each of raking and compressing up, and of doubling down"


def test_rows_that_are_no_tree(spark):
    loop = spark.createDataFrame([("t", "a", "b", "", 1.0, False), ("t", "b", "a", "", 1.0, False)], NODES)
    with pytest.raises(ValueError, match="cycle"):
        W.jump_table(loop)
    lost = spark.createDataFrame([("t", "a", None, "", 1.0, False), ("t", "b", "x", "b", 1.0, True)], NODES)
    with pytest.raises(ValueError, match="not a node"):
        W.jump_table(lost)
    with pytest.raises(ValueError, match="not a node"):
        W.parsimony(lost, spark.createDataFrame([("b", "s")], "name string, state string"))
    star = spark.createDataFrame([("t", "a", None, "", 1.0, False)] + [("t", f"l{i}", "a", f"l{i}", 1.0, True) for i in range(70)], NODES)
    with pytest.raises(ValueError, match="states"):
        W.parsimony(star, star.select("name", F.col("name").alias("state")))
    none = spark.createDataFrame([], NODES)
    assert W.jump_table(none)[0].count() == 0
    assert W.parsimony(none, spark.createDataFrame([], "name string, state string")).count() == 0


def test_set_functions_compose():
    r = random.Random(6)
    for _ in range(300):
        s = r.randrange(1, 6)
        chain = []
        for _ in range(r.randrange(1, 20)):
            votes = [v for v in (r.randrange(1 << s) for _ in range(r.randrange(3))) if v]
            shared, any_ = -1, 0
            for v in votes:
                shared, any_ = shared & v, any_ | v
            chain.append((shared, any_))
        fs = [[0, -1, 0, -1] if not u else [i, i, 0, i, -1, u, -1] if i else [u, -1, u, -1] for i, u in chain]
        while len(fs) > 1:
            k = r.randrange(len(fs) - 1)
            fs[k : k + 2] = [W.composed(fs[k + 1], fs[k])]
        assert (len(fs[0]) - 1) // 3 <= s + 1
        for x in range(1 << s):
            y = x
            for shared, any_ in chain:
                y = y if not any_ else (shared or any_) if not y else (shared & y) or (any_ | y)
            assert W.applied(fs[0], x) == y


def test_switches_by_both_forms(spark):
    """The job form for small trees, a task each, and the contraction agree on where states change."""
    text = "(((a:1,b:1):1,c:1):1,(d:1,(e:1,f:1):1):1);"
    trees = spark.createDataFrame([("t", text)], "tree_id string, newick string")
    state = {"a": "x", "b": "x", "c": "y", "d": "y", "e": "x", "f": "y"}
    n = T.N.tree_nodes(trees)
    states = spark.createDataFrame(list(state.items()), "name string, state string")
    got = {(x.child_id, x.parent_state, x.child_state) for x in T.switches(n, W.parsimony(n, states)).collect()}
    want = T.fitch_states(T.N.parse(text), state)
    assert got == {(c["node_id"], want[c["parent_id"]], want[c["node_id"]]) for c in T.N.parse(text) if c["parent_id"] is not None and None not in (want[c["parent_id"]], want[c["node_id"]]) and want[c["parent_id"]] != want[c["node_id"]]}
