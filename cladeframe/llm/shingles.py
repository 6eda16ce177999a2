"""Near duplicates by the exact Jaccard similarity of word shingles, found without comparing all pairs.

In any one order of all shingles, two sets of similarity s at least share a shingle within their first n - ceil(s * n) + 1
(n a set's size), so a set is dealt to one cell for each of those and every similar pair meets in a cell. Rare shingles come
first, as counted in all rows by their bucket: another order changes the work, never the result. Pairs that meet are compared in full. Whoever calls can
give pairs to begin with, such as those of an index of fingerprints: they are compared first, and what they link isn't sought again.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import BROADCAST_IDS, by_ids, freed, need, scratch, staged
from cladeframe.llm.components import components
from cladeframe.llm.tokens import in_slices

SEED = 42
#: Buckets, by the low bits of their hash, in which the shingles of all rows are counted: 8 MB in each worker.
BUCKETS = 1 << 20
#: Cells of more sets than SMALL begin with pairs of one of them with all others, in PIVOT_ROUNDS rounds; then all left in them that are still apart are paired.
SMALL, PIVOT_ROUNDS = 2, 4
#: Slack for rounding in bounds; it only lets more pairs be compared.
EPS = 1e-6


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of a text's runs of so many words, repeats included; words are split and lower-cased as for fingerprints."""
    from xxhash import xxh64_intdigest as digest

    own = text.lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    if len(own) <= words:
        return np.array([digest(b" ".join(own), SEED)], np.uint64)
    joined = b" ".join(own)
    at = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = [0, *at[: len(own) - words].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (at[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct shingles, as signed longs."""
    return np.unique(shingle_hashes(text, words).view(np.int64))


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes: a bit is set if over half of them have it. An empty list has 0."""
    size = np.array([len(h) for h in hashes])
    has = size > 0
    fp = np.zeros(len(hashes), np.uint64)
    if has.any():
        bits = np.unpackbits(np.concatenate(hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begin = np.cumsum(size[has]) - size[has]
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        fp[has] = np.packbits(2 * ones > size[has][:, None], axis=1).view(">u8").ravel()
    return fp


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """For each bucket, in how many rows its shingles are, summed over all rows and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in in_slices(batch.column(1)):
                own += np.bincount(np.concatenate([shingle_set(t, words) for t in texts]) & (BUCKETS - 1), minlength=BUCKETS)
        met = np.flatnonzero(own)
        for at in range(0, len(met), 65536):
            some = met[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some])], names=["bucket", "n"])

    found = staged(_rows(docs).mapInArrow(freed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "shingle-counts", texts=True).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefixes(docs: DataFrame, words: int, similar: float) -> DataFrame:
    """doc_id, node (a hash of the set of shingles), size, fp (fingerprint of its shingles), prefix (its rarest, in order) of every row."""
    often = shingle_counts(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for batch in batches:
            for first, texts in in_slices(batch.column(1)):
                nodes, sizes, firsts = [], [], []
                every = [shingle_hashes(t, words) for t in texts]
                fps = majority_bits(every)
                for own in every:
                    h = np.unique(own.view(np.int64))
                    nodes.append(digest(h.tobytes(), SEED))
                    sizes.append(len(h))
                    h = h[np.argsort(often[h & (BUCKETS - 1)], kind="stable")]
                    firsts.append(h[: len(h) - int(np.ceil(similar * len(h) - EPS)) + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps.view(np.int64)), _lists(firsts)], names=["doc_id", "node", "size", "fp", "prefix"])

    return _rows(docs).mapInArrow(freed(run), "doc_id long, node long, size long, fp long, prefix array<long>")


def _may_match(a: str, b: str, similar: float) -> Column:
    """Whether two sets of a cell can be similar, were its shingle the first they share: by sizes and by what follows it."""
    na, nb = F.col(f"{a}.size"), F.col(f"{b}.size")
    left = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    return (F.least(na, nb) >= similar * F.greatest(na, nb) - EPS) & ((1 + similar) * left >= similar * (na + nb) - EPS)


def candidates(cells: DataFrame, similar: float, small: int | None) -> DataFrame:
    """Pairs (a < b) of unlinked nodes to compare. Cells (key, me: at, node, size, component; n, low) above small only pair low with all."""
    apart = (F.col("x.component") != F.col("y.component")) & _may_match("x", "y", similar)
    pairs = []
    if small is None or small > 2:
        few = cells if small is None else cells.where(F.col("n") <= small)
        x, y = (few.select("key", F.col("me").alias(name)) for name in "xy")
        pairs.append(x.join(y, "key").where((F.col("x.node") < F.col("y.node")) & apart).select("x.node", "y.node"))
    if small is not None:
        # A cell of two is the pair of its low with the other. low has the fewest rarer shingles before the key: in a group
        # of near copies it is the text that the others vary, the same one in most cells, so its pairs are the same too.
        rest = cells if small <= 2 else cells.where(F.col("n") > small)
        pairs.append(rest.select(F.col("low").alias("x"), F.col("me").alias("y")).where((F.col("x.node") != F.col("y.node")) & apart).select("x.node", "y.node"))
    both = reduce(DataFrame.union, pairs).toDF("x", "y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row for each node; only those of repeated (staged) can have more."""
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, "node", "left_anti").unionByName(rows.join(repeated, "node", "left_semi").dropDuplicates(["node"]))


def similar_pairs(pairs: DataFrame, docs: DataFrame, least: DataFrame, repeated: DataFrame, words: int, similar: float) -> DataFrame:
    """Those pairs of nodes whose whole sets of shingles are similar, staged. least: node, doc_id of a row that has the node; repeated: nodes of which that isn't one row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for batch in batches:
            for first, texts in in_slices(batch.column(1)):
                own = [shingle_set(t, words) for t in texts]
                nodes = np.array([digest(h.tobytes(), SEED) for h in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(nodes), _lists(own)], names=["doc_id", "node", "set"])

    with scratch(docs.sparkSession):
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = staged(least.join(nodes, "node").select(F.col("node").alias("_node"), F.col("doc_id").alias("_id")), "compared")
        ids = staged(wanted.select("_id").distinct(), "compared-ids")
        # Rows without an id are few or none; all of them are read.
        rows = by_ids(docs.select("doc_id", "text"), ids, "left_semi").unionByName(docs.select("doc_id", "text").where("doc_id IS NULL"))
        few = wanted.count() <= BROADCAST_IDS
        known = _rows(rows).mapInArrow(freed(sets), "doc_id long, node long, set array<long>").join(F.broadcast(wanted) if few else wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        known = staged(known.select("node", "set"), "sets", texts=True)
        known = once(known, repeated)
        met = pairs.join(known.select(F.col("node").alias("a"), F.col("set").alias("p")), "a").join(known.select(F.col("node").alias("b"), F.col("set").alias("q")), "b")
        return staged(met.where((1 + similar) * F.size(F.array_intersect("p", "q")) >= similar * (F.size("p") + F.size("q")) - EPS).select("a", "b"), "similar-pairs", lasting=True)


def may_overlap(pairs: DataFrame, one: DataFrame, similar: float) -> DataFrame:
    """Those pairs of nodes whose prefixes share enough for their whole sets to be similar, staged. one: node, size, prefix.

    Of two prefixes, one ends no later in the order of all shingles: what both sets share up to there is in both prefixes,
    and beyond it that set has only its rest. So shared shingles of prefixes, and the larger rest, bound what is shared.
    """
    with scratch(one.sparkSession):
        nodes = staged(pairs.select(F.col("a").alias("_met")).union(pairs.select("b")).distinct(), "met")
        firsts = staged(by_ids(one, nodes, "left_semi", "node").select("node", F.struct("size", "prefix").alias("of")), "met-prefixes")
        met = pairs.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b")
        rest = F.greatest(*[F.col(f"{s}.size") - F.size(f"{s}.prefix") for s in "xy"])
        most = F.size(F.array_intersect("x.prefix", "y.prefix")) + rest
        return staged(met.where((1 + similar) * most >= similar * (F.col("x.size") + F.col("y.size")) - EPS).select("a", "b"), "possible-pairs", lasting=True)


#: From a DataFrame of distinct fingerprints (column fp) to links (a, b) between them.
Index = Callable[[DataFrame], DataFrame]


def proposed(marked: DataFrame, index: Index, similar: float) -> DataFrame:
    """Pairs of nodes (a < b) whose fingerprints are equal or linked by the index, and whose sizes allow the similarity."""
    nodes = marked.groupBy("fp", "node").agg(F.first("size").alias("size"))
    # One node stands for a fingerprint: the rest of its nodes, and its links, lead there.
    named = staged(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("one")), "fingerprint-nodes")
    same = nodes.join(named, "fp").select(F.struct("node", "size").alias("x"), F.col("one").alias("y"))
    end = lambda fp, name: named.select(F.col("fp").alias(fp), F.col("one").alias(name))
    linked = index(named.select("fp")).join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    both = same.union(linked).where((F.col("x.node") != F.col("y.node")) & (F.least("x.size", "y.size") >= similar * F.greatest("x.size", "y.size") - EPS))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def similar_groups(docs: DataFrame, words: int = 5, similar: float = 0.8, small: int = SMALL, index: Index | None = None) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over pairs of that Jaccard similarity or more, itself included) of every row.

    Texts without words are one group. Sets that are equal are one node. A link is only sought between nodes not yet
    connected, so a large group of near copies costs its size, not its square. With index, the pairs it proposes are
    compared first; the groups are the same. Null doc_ids never name a group that has another. The result is staged.
    """
    need(docs, "doc_id", "text")
    with scratch(docs.sparkSession):
        return staged(_similar_groups(docs, words, similar, small, index), "near-duplicates", lasting=True)


def _similar_groups(docs: DataFrame, words: int, similar: float, small: int, index: Index | None) -> DataFrame:
    with scratch(docs.sparkSession):
        whole = staged(prefixes(docs, words, similar), "prefixes", texts=True)
        marked = staged(whole.drop("prefix"), "marked", lasting=True)
        least = staged(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes", lasting=True)
        first = least.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
        # Rows that repeat an id and a text give a node several times, with the same prefix.
        repeated = staged(marked.groupBy("node", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select("node").distinct(), "repeated-nodes", lasting=True)
        of_least = whole.join(first, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        one = staged(once(of_least.select("node", "size", "prefix"), repeated), "node-prefixes", lasting=True)
    in_cell = Window.partitionBy("key").orderBy("node")
    dealt = one.select("node", "size", F.posexplode("prefix").alias("at", "key"))
    met = dealt.withColumns({"before": F.lag("node").over(in_cell), "after": F.lead("node").over(in_cell)}).where("before <> node OR after <> node")
    cells = staged(met.select("key", "node", "size", "at"), "cells")
    links: DataFrame | None = None
    named = least.select("node", F.col("node").alias("component"))

    def connected(pairs: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        found = similar_pairs(may_overlap(pairs, one, similar), docs, least, repeated, words, similar)
        found = found if before is None else before.unionByName(found)
        linked = components(found)
        return found, staged(least.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")

    if index is not None:
        first_pairs = staged(proposed(marked, index, similar), "proposed")
        if not first_pairs.isEmpty():
            links, named = connected(first_pairs, links)
    open_ = cells.join(named, "node")
    for number in itertools.count(1):
        own = open_.select("key", F.struct("at", "node", "size", "component").alias("me"))
        of_key = own.groupBy("key").agg(F.count("*").alias("n"), F.min("me").alias("low"), F.min("me.component").alias("c"), F.max("me.component").alias("d"))
        cells = staged(own.join(of_key.where("c <> d").drop("c", "d"), "key"), "open-cells")
        most = small if number <= PIVOT_ROUNDS else None
        pairs = staged(candidates(cells, similar, most), "candidates")
        if not pairs.isEmpty():
            links, named = connected(pairs, links)
        if most is None:
            break
        # The pivot of a large cell has met all others; small cells are done.
        left = cells.where((F.col("n") > most) & (F.col("me.node") != F.col("low.node")))
        if left.isEmpty():
            break
        open_ = left.select("key", "me.node", "me.size", "me.at").join(named, "node")
    ids = named.join(least, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(ids, "component").select("node", "component_id")
    return marked.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")
