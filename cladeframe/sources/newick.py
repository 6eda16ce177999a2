"""Newick trees as rows: one per node, with its ancestors, so that tree questions become joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "tree_id string, node_id int, parent_id int, name string, dist double, is_leaf boolean, depth int, root_dist double, edge_num int, postorder int, ancestors array<int>"
_TOKEN = re.compile(r"\s*([(),;]|[^(),;]+)")
_LABEL = re.compile(r"^([^:{]*)(?::([^{]*))?(?:\{(\d+)\})?$")


def parse(text: str) -> list[dict]:
    """Nodes in preorder. ValueError for text that isn't one tree. A missing length is 0.

    Labels may be a name or a support value, a length and an edge number: name:0.1{7}.
    """
    nodes: list[dict] = []
    open_: list[int] = []
    order = 0

    def add(parent: int | None) -> int:
        nodes.append({"node_id": len(nodes), "parent_id": parent, "name": "", "dist": 0.0, "edge_num": None, "is_leaf": True, "postorder": -1})
        return len(nodes) - 1

    def close(i: int) -> None:
        nonlocal order
        nodes[i]["postorder"] = order
        order += 1

    current = add(None)
    labelled: set[int] = set()
    done = False
    for token in _TOKEN.findall(text.strip()):
        if done:
            raise ValueError("text after the tree")
        if token == "(":
            if not nodes[current]["is_leaf"] or current in labelled:
                raise ValueError("unexpected (")
            nodes[current]["is_leaf"] = False
            open_.append(current)
            current = add(current)
        elif token in ",)":
            if not open_:
                raise ValueError(f"unexpected {token}")
            close(current)
            if token == ",":
                current = add(open_[-1])
            else:
                current = open_.pop()
        elif token == ";":
            done = True
        else:
            m = _LABEL.match(token.strip())
            if not m or current in labelled:
                raise ValueError(f"bad label {token!r}")
            labelled.add(current)
            nodes[current]["name"] = m[1].strip()
            nodes[current]["dist"] = float(m[2]) if m[2] and m[2].strip() else 0.0
            nodes[current]["edge_num"] = int(m[3]) if m[3] else None
    if open_ or not done and not text.strip():
        raise ValueError("the tree doesn't end")
    close(current)
    if any(n["is_leaf"] and not n["name"] for n in nodes):
        raise ValueError("a leaf has no name")
    for n in nodes:
        p = n["parent_id"]
        n["ancestors"] = [n["node_id"]] if p is None else [*nodes[p]["ancestors"], n["node_id"]]
        n["depth"] = len(n["ancestors"]) - 1
        n["root_dist"] = n["dist"] if p is None else nodes[p]["root_dist"] + n["dist"]
    return nodes


def write(nodes: list[dict], with_dist: bool = True, internal_names: bool = True, mark: int | None = None, label: str = "#1") -> str:
    """A tree's nodes as Newick text; a marked node's label follows its name."""
    below: dict[int | None, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: n["node_id"]):
        below.setdefault(n["parent_id"], []).append(n)

    text: dict[int, str] = {}
    for n in sorted(nodes, key=lambda n: n["postorder"]):
        own = below.get(n["node_id"], [])
        out = "(" + ",".join(text[c["node_id"]] for c in own) + ")" if own else ""
        if not own or internal_names:
            out += n["name"]
        if n["node_id"] == mark:
            out += f" {label}"
        if with_dist and n["parent_id"] is not None:
            out += f":{n['dist']:g}"
        text[n["node_id"]] = out
    (root,) = below[None]
    return text[root["node_id"]] + ";"


def tree_nodes(trees: DataFrame, tree_id: str = "tree_id", newick: str = "newick") -> DataFrame:
    """One row per node of each tree (tree_id, newick); ancestors run from the root to the node itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        for batch in batches:
            rows = [{"tree_id": t, **n} for t, text in zip(batch["tree_id"], batch["newick"], strict=True) for n in parse(text)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("parent_id", "edge_num"):
                out[c] = out[c].astype("Int32")
            yield out

    return trees.select(F.col(tree_id).cast("string").alias("tree_id"), F.col(newick).alias("newick")).mapInPandas(run, NODES)
