"""SimHash near-duplicates, linked through a hierarchical index in Gray order.

Fingerprints that differ in at most d bits agree on at least m-d of m blocks, so every choice of m-d
blocks deals the distinct fingerprints into cells, and a link shows in at least one cell. In a cell
the fingerprints are sorted by Gray rank; neighbours then share bits, upper nodes hold the bits that all
below them share (value and mask), and a pair of nodes is dropped as a whole once the differences
accumulated on the way down exceed d. A cell yields a spanning set of links, not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import by_ids, freed, need, shuffle_partitions, staged
from cladeframe.llm.components import components
from cladeframe.llm.shingles import majority_bits, shingle_hashes, similar_groups
from cladeframe.llm.tokens import in_slices

WORDS, BITS = 4, 4
#: Distinct fingerprints that a cell should hold on average; decides into how many blocks the 64 bits go.
CELL = 2048
#: Fingerprints compared at once. A larger cell is dealt into chunks, and each pair of chunks is a task's work.
CHUNK = 16384
LEAF, FAN = 16, 8

FINGERPRINTS = "doc_id long, fp long"


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row.

    Text is lower-cased in A-Z; words are runs of other than ASCII white space; a shingle is so many words
    joined by spaces, repeats included; fewer words make one shingle. A bit is set if it is in over half
    the shingles' XXH64. Null and empty texts have fingerprint 0.
    """
    need(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_slices(batch.column(1)):
                fp = majority_bits([shingle_hashes(t, words) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(freed(run), FINGERPRINTS)


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit pattern in the reflected Gray order, shifted so that signed order is right."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks(blocks: int, bits: int) -> list[int]:
    """For each choice of blocks-bits blocks the mask of their bits, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(c) for c in itertools.combinations(one, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, bits: int, cell: int = CELL) -> int:
    """The fewest blocks with which a cell of n evenly spread fingerprints holds at most cell."""
    m = bits + 1
    while m < bits + 6 and n / 2 ** (64 * (m - bits) / m) > cell:
        m += 1
    return m


class GrayTree:
    """Levels of nodes over sorted fingerprints; a node keeps the bits all below it share, and which those are."""

    def __init__(self, x: np.ndarray):
        starts = np.arange(0, len(x), LEAF)
        every, some = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
        self.levels = [(every, ~(every ^ some))]
        while len(every) > FAN:
            starts = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
            self.levels.append((every, ~(every ^ some)))

    def near_leaves(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (a <= b) that may hold fingerprints at most bits apart."""
        n = len(self.levels[-1][0])
        a, b = np.triu_indices(n)
        known = np.zeros(len(a), np.uint64)
        apart = np.zeros(len(a), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            value, mask = self.levels[depth]
            both = mask[a] & mask[b]
            # Bits that were shared further up have been counted there.
            apart = apart + np.bitwise_count((value[a] ^ value[b]) & both & ~known)
            keep = apart <= bits
            a, b, known, apart = a[keep], b[keep], both[keep], apart[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                step = np.arange(FAN)
                ca = (a[:, None, None] * FAN + step[None, :, None] + 0 * step[None, None, :]).reshape(-1)
                cb = (b[:, None, None] * FAN + step[None, None, :] + 0 * step[None, :, None]).reshape(-1)
                ok = (ca < below) & (cb < below) & (ca <= cb)
                a, b = ca[ok], cb[ok]
                known, apart = np.repeat(known, FAN * FAN)[ok], np.repeat(apart, FAN * FAN)[ok]
        return a, b


def cell_links(x: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (positions in x) that connect what pairs of x at most bits apart connect; x in Gray order."""
    n = len(x)
    label = np.arange(n)
    out: list[tuple[int, int]] = []

    def join(i: int, others: np.ndarray) -> None:
        for root, at in zip(*np.unique(label[others], return_index=True), strict=True):
            own = label[i]
            if root != own:
                out.append((i, int(others[at])))
                label[label == max(root, own)] = min(root, own)

    if n <= 3 * LEAF:
        i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= bits, 1))
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            join(p, np.array([q]))
        return out
    a, b = GrayTree(x).near_leaves(bits)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        others = (b[s:e, None] * LEAF + np.arange(LEAF)).reshape(-1)
        others = others[others < n]
        lo = a[s] * LEAF
        rows = np.arange(lo, min(lo + LEAF, n))
        near = np.bitwise_count(x[rows][:, None] ^ x[others][None, :]) <= bits
        near &= others[None, :] > rows[:, None]
        near &= label[others][None, :] != label[rows][:, None]
        for r in np.flatnonzero(near.any(axis=1)):
            join(int(rows[r]), others[near[r]])
    return out


def links(distinct: DataFrame, bits: int = BITS, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect just what pairs at most bits apart do."""
    spark = distinct.sparkSession
    masks = block_masks(blocks_for(distinct.count(), bits, cell), bits)
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("c")).select("fp", "c.t", "c.key")
    large = staged(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "large-cells")
    if large.isEmpty():
        cells = dealt.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        # A large cell's fingerprints go to chunks; every pair of chunks meets in a cell of its own.
        chunks = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
        met = dealt.join(large, ["t", "key"], "left").withColumn("k", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        cells = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("fp", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(x: np.ndarray) -> pa.RecordBatch | None:
            got = cell_links(x.view(np.uint64), bits) if len(x) > 1 else []
            if not got:
                return None
            p = np.array(got)
            return pa.RecordBatch.from_arrays([pa.array(x[p[:, 0]]), pa.array(x[p[:, 1]])], names=["a", "b"])

        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            fp = batch.column(0).to_numpy()
            names = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(1, 5)], axis=1)
            if not len(fp):
                continue
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            parts = np.split(fp, cuts)
            if last is not None and (last != names[0]).any():
                if (out := found(np.concatenate(held))) is not None:
                    yield out
                held = []
            for part in parts[:-1]:
                if (out := found(np.concatenate([*held, part]))) is not None:
                    yield out
                held = []
            held.append(parts[-1])
            last = names[-1]
        if held and (out := found(np.concatenate(held))) is not None:
            yield out

    sorted_cells = cells.repartition(shuffle_partitions(spark), "t", "key", "i", "j").withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("t", "key", "i", "j", "rank")
    return sorted_cells.select("fp", "t", "key", "i", "j").mapInArrow(freed(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, itself included) of every row.

    Equal fingerprints are one node, so copies cost a partial aggregate. Null doc_ids are never a
    component's name unless it has no other. Repeated rows are returned each. Empty in, empty out.
    """
    marked = staged(fingerprints(docs, words), "fingerprints", texts=True)
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(distinct.select("fp"), bits, cell, chunk))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS, similar: float | None = None) -> DataFrame:
    """The rows of docs, all columns, that stand for their group of near duplicates: that of the smallest doc_id, once.

    Without similar, fingerprints at most bits apart are linked. With similar, the pairs that the index of fingerprints
    proposes are linked if the Jaccard similarity of their sets of shingles is at least that; as no bound on 64 bits
    finds all such pairs, those between groups still apart are then found from rare shingles, exactly. Null and empty
    texts are copies of each other; of repeated rows one stays. Rows without a doc_id can't be named and all stay. An
    empty table stays empty.
    """
    texts = docs.select("doc_id", "text")
    found = staged(near_duplicates(texts, words, bits), "near-duplicates") if similar is None else similar_groups(texts, words, similar, index=lambda fps: links(fps, bits))
    groups = found.where("doc_id IS NOT NULL")
    gone = staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    repeated = staged(groups.groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again"), "repeated")
    left = by_ids(docs, gone, "left_anti")
    if repeated.isEmpty():
        return left
    # A text whose id comes again may differ; one row stays for each id.
    return by_ids(left, repeated, "left_anti").unionByName(by_ids(left, repeated, "left_semi").dropDuplicates(["doc_id"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; null, empty and repeated rows as in near_duplicates()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
