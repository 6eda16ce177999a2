"""Benchmark decontamination by spaced seeds.

Fixed masks take five of a few neighbouring tokens and ignore the rest, so a changed word spoils only
the windows that look at it. Hashes of benchmark windows, as a bit set of fixed size, tell which windows
of a document to keep; those are joined with the benchmark's windows on the hash, and every alignment
(document, item, offset) that a hit proposes is verified token by token around the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import by_ids, freed, need, staged
from cladeframe.llm.tokens import in_slices

#: Positions in a window that count; each mask takes five tokens.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7))
SPAN = max(m[-1] for m in MASKS) + 1
#: Items of fewer tokens than this have masks of their own, as a changed word may spoil all of those above.
SHORT = 7
#: Tokens that must be aligned (or the whole item, if it is shorter), and the share of them that must be equal.
OVERLAP, SIMILARITY = 13, 0.8
#: Tokens kept around a hit: an overlap that holds the hit lies within.
MARGIN = OVERLAP + SPAN
#: The bit set's bits, as a power of two: 1 MB whatever the benchmark's size; a hash sets and asks two of them. A fuller
#: set lets more windows through to the exact join, no fewer.
FILTER = 23
_SECOND = np.uint64(0x9FB21C651E98DF25)
#: Benchmark windows up to which they are broadcast (48 MB); beyond, the join shuffles both sides.
BROADCAST_WINDOWS = 2_000_000
_EDGE = bytes(c for c in range(1, 128) if not chr(c).isalnum())
_MULTIPLIER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def token_hashes(text: bytes | None) -> np.ndarray:
    """A hash of each word, lower-cased in A-Z and without ASCII punctuation at its ends; empty ones are left out."""
    from xxhash import xxh64_intdigest as digest

    if not text:
        return np.zeros(0, np.uint64)
    words = [w for x in text.lower().split() if (w := x.strip(_EDGE))]
    return np.array([digest(w) for w in words], np.uint64)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """For items of n < SHORT tokens: all of them, or, where one may differ within the similarity, all but one."""
    every = tuple(range(n))
    return [every] if n - 1 < SIMILARITY * n else [every[:gap] + every[gap + 1 :] for gap in range(n)]


def windows(tokens: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all masked windows, and where each starts. A text shorter than a mask has none by it.

    short: the lengths of short items whose masks are used besides.
    """
    found, at = [], []
    for k, mask in [*enumerate(MASKS), *((16 * n + g, m) for n in short for g, m in enumerate(short_masks(n)))]:
        n = len(tokens) - mask[-1]
        if n > 0:
            h = np.full(n, (k + 1) * 0x5851F42D4C957F2D & (2**64 - 1), np.uint64)
            for m, offset in zip(_MULTIPLIER, mask, strict=False):
                h = (h ^ (tokens[offset : offset + n] * m)) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(29)
            found.append(h)
            at.append(np.arange(n))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(at)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, tokens, hashes, at of every item. Null texts and items without a word have no window."""
    need(benchmark, "item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [token_hashes(t) for t in batch.column(1).to_pylist()]
            pairs = [windows(t, (len(t),) if 0 < len(t) < SHORT else ()) for t in tokens]
            longs = lambda xs: pa.array([x.astype(np.int64) for x in xs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), longs([t.view(np.int64) for t in tokens]), longs([h.view(np.int64) for h, _ in pairs]), longs([a for _, a in pairs])], names=["item_id", "tokens", "hashes", "at"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(freed(run), "item_id long, tokens array<long>, hashes array<long>, at array<long>")


def bit_set(hashes: DataFrame) -> np.ndarray:
    """Two bits for each hash: built in eight tasks at most, of which each sends its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER, bool)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            bits[h >> np.uint64(64 - FILTER)] = True
            bits[(h * _SECOND) >> np.uint64(64 - FILTER)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    sets = hashes.coalesce(8).mapInArrow(freed(run), "bits binary").collect()
    out = np.zeros(1 << FILTER >> 3, np.uint8)
    for r in sets:
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def regions(docs: DataFrame, bits: np.ndarray, short: tuple[int, ...] = ()) -> DataFrame:
    """Stretches of documents around windows whose hash may be the benchmark's: doc_id, start, tokens, hashes, at.

    Hits closer than two margins share a stretch; at counts from the stretch's first token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits).view(bool)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for first, texts in in_slices(batch.column(1)):
                for doc_id, text in zip(ids[first:], texts, strict=False):
                    tokens = token_hashes(text)
                    h, at = windows(tokens, short)
                    hit = np.flatnonzero(known[h >> np.uint64(64 - FILTER)])
                    hit = hit[known[(h[hit] * _SECOND) >> np.uint64(64 - FILTER)]]
                    if not len(hit):
                        continue
                    h, at = h[hit], at[hit]
                    order = np.argsort(at, kind="stable")
                    h, at = h[order], at[order]
                    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * MARGIN) + 1):
                        lo, hi = max(0, int(at[part[0]]) - MARGIN), min(len(tokens), int(at[part[-1]]) + SPAN + MARGIN)
                        out.append((doc_id, lo, tokens[lo:hi].view(np.int64), h[part].view(np.int64), at[part] - lo))
            if out:
                c = list(zip(*out, strict=True))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in c[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *lists], names=["doc_id", "start", "tokens", "hashes", "at"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, start long, tokens array<long>, hashes array<long>, at array<long>")


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, float] | None:
    """The stretch of doc, aligned with item (doc position - item position = shift), that passes; else None.

    It is the union of the passing windows of OVERLAP tokens (of the whole item, if that is shorter).
    """
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    size = min(OVERLAP, len(item))
    if hi - lo < size or size == 0:
        return None
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[size:] - total[:-size] >= SIMILARITY * size)
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + size
    return lo + a, lo + b, float(total[b] - total[a]) / (b - a)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (document tokens), similarity: one row per verified overlap.

    An item of fewer than OVERLAP tokens must be met whole, but for the share of tokens that may differ. Null and empty texts have none. Repeated documents or items give their rows each. Empty tables give an
    empty result. Other columns are ignored. Documents' texts aren't shuffled.
    """
    need(docs, "doc_id", "text")
    items = staged(benchmark_windows(benchmark), "benchmark-windows").withColumn("item", F.monotonically_increasing_id())
    index = items.select("item", F.inline(F.arrays_zip("hashes", "at"))).select(F.col("hashes").alias("hash"), "item", F.col("at").alias("item_at"))
    bits = bit_set(index.select("hash"))
    # A number for each length below SHORT that some item has.
    short = tuple(sorted(r["n"] for r in items.select(F.size("tokens").alias("n")).where((F.col("n") > 0) & (F.col("n") < SHORT)).distinct().collect()))
    near = staged(regions(docs, bits, short), "regions", texts=True).withColumn("region", F.monotonically_increasing_id())
    hits = near.select("region", F.inline(F.arrays_zip("hashes", "at"))).select("region", F.col("hashes").alias("hash"), "at")
    small = index.count() <= BROADCAST_WINDOWS
    shared = F.broadcast if small else (lambda x: x)
    aligned = hits.join(shared(index), "hash").select("region", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = aligned.join(near.select("region", "doc_id", "start", F.col("tokens").alias("doc_tokens")), "region").join(shared(items.select("item", "item_id", F.col("tokens").alias("item_tokens"))), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            doc_lists, item_lists = batch.column(3), batch.column(4)
            for i, (doc_id, item_id, start, shift) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5)), strict=True)):
                got = best_overlap(doc_lists[i].values.to_numpy(), item_lists[i].values.to_numpy(), shift)
                if got:
                    out.append((doc_id, item_id, start + got[0], start + got[1], got[2]))
            if out:
                c = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["doc_id", "item_id", "start", "end", "similarity"])

    ordered = pairs.select("doc_id", "item_id", "start", "doc_tokens", "item_tokens", "shift")
    return ordered.mapInArrow(freed(verify), "doc_id long, item_id long, start long, end long, similarity double")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, start, end, similarity of the first longest overlap."""
    best = F.max_by(F.struct("start", "end", "similarity"), F.struct(F.col("end") - F.col("start"), F.col("similarity"), -F.col("start")))
    return overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", "b.end", "b.similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that overlap no benchmark item: null and empty texts among them, and rows
    without an id. All rows of an id go if one of them overlaps. An empty table stays empty."""
    bad = overlaps(docs, benchmark).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_bad")).distinct()
    return by_ids(docs, staged(bad, "contaminated"), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that overlap; others, null and empty texts among them, have none."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
