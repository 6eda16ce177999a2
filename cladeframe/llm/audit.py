"""Filter interaction audit: what each of several filters removes in every order of applying them.

A packed bitmap index holds, for each part of a partition, one bit a document for each filter's failure and each label.
Every set of filters that can come first is then an OR of bitmaps, what it keeps an AND-NOT, and a count a popcount; counts
of partitions are summed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import freed, need, scratch, staged
from cladeframe.llm.mixing import WORD

FILTERS = "ABCDE"
LABELS = ("good", "toxic")
#: Salts over which the rows of one text are dealt when they look up the text's first document.
SALTS = 16
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 4096


def failures(text: Column) -> list[Column]:
    """Failure of filters A to D: too short, repetitive, shouting, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [
        (F.size(words) < 200).alias("A"),
        (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)).alias("B"),
        (100 * capitals > 3 * F.length(text)).alias("C"),
        text.rlike(r"[#$%&*|]").alias("D"),
    ]


def repeats(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) with E: the digest also belongs to a smaller doc_id. Null ids never fail."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    # A text with very many copies is one row here and SALTS rows below; its documents are dealt over as many tasks.
    dealt = first.select("digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return own.join(dealt, ["digest", "_salt"], "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))).drop("_first", "_salt")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A, B, C, D, E, good, toxic: a row per row of docs (doc_id, text, lang). Texts are read once and not shuffled."""
    need(docs, "doc_id", "text", "lang")
    need(labels, "doc_id", "quality", "toxic")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *failures(text))
    rows = staged(rows, "audit-failures")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    met = repeats(rows).drop("digest").join(said.where("doc_id IS NOT NULL AND (good OR toxic)"), "doc_id", "left")
    return met.select("part", *FILTERS, *[F.coalesce(F.col(x), F.lit(False)).alias(x) for x in LABELS])


BITMAPS = ("live", *FILTERS, *LABELS)
INDEX = pa.schema([("part", pa.string()), *[(b, pa.binary()) for b in BITMAPS]])
INDEX_DDL = "part string, " + ", ".join(f"{b} binary" for b in BITMAPS)


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row per part of the batch; its bitmaps are padded to whole 64-bit words, live marks the bits that are documents."""
    part = batch.column(batch.schema.get_field_index("part")).dictionary_encode()
    codes = part.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(part.dictionary))
    words = -(-counts // 64)
    bounds = np.concatenate([[0], np.cumsum(words)]) * 8
    starts = np.cumsum(counts) - counts
    at = np.arange(len(codes)) - np.repeat(starts, counts) + np.repeat(bounds[:-1] * 8, counts)
    columns: list[pa.Array] = [part.dictionary]
    for name in BITMAPS:
        bits = np.zeros(bounds[-1] * 8, dtype=bool)
        bits[at] = True if name == "live" else batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)[order]
        columns.append(pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.packbits(bits))]))
    return pa.RecordBatch.from_arrays(columns, schema=INDEX)


def bitmap_index(rows: DataFrame) -> DataFrame:
    """part and one packed bitmap for live, each filter and each label: a row per part of each Arrow batch of judged() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_packed(b) for b in batches if b.num_rows)

    return rows.mapInArrow(freed(run), INDEX_DDL)


COUNTS = pa.schema([("part", pa.string()), ("first", pa.int32()), ("kept", pa.int64()), *[(x, pa.int64()) for x in LABELS]])
COUNTS_DDL = "part string, first int, kept long, good long, toxic long"
SETS = 1 << len(FILTERS)


def _popcounts(batch: pa.RecordBatch) -> np.ndarray:
    """For each row of an index batch, each set of filters and each of kept, good, toxic: the set bits that no filter of the set fails."""
    plane, bounds = {}, None
    for name in BITMAPS:
        column = batch.column(batch.schema.get_field_index(name))
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        plane[name] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
        bounds = (offsets[:-1] - offsets[0]) // 8
    failing = np.zeros((SETS, len(plane["live"])), dtype=np.uint64)
    out = np.empty((batch.num_rows, SETS, 1 + len(LABELS)), dtype=np.int64)
    for s in range(SETS):
        if s:
            low = (s & -s).bit_length() - 1
            failing[s] = failing[s & (s - 1)] | plane[FILTERS[low]]
        kept = plane["live"] & ~failing[s]
        for k, also in enumerate((kept, *[kept & plane[x] for x in LABELS])):
            out[:, s, k] = np.add.reduceat(np.bitwise_count(also).astype(np.int64), bounds)
    return out


def prefix_counts(index: DataFrame) -> DataFrame:
    """part, first (a set of filters as bits, A lowest), and documents, good and toxic ones that pass all filters of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            table = np.concatenate([v for v in held.values()])
            parts = pa.array(np.repeat(np.array(list(held), dtype=object), SETS), pa.string())
            sets = pa.array(np.tile(np.arange(SETS, dtype=np.int32), len(held)))
            return pa.RecordBatch.from_arrays([parts, sets, *[pa.array(table[:, k]) for k in range(1 + len(LABELS))]], schema=COUNTS)

        for batch in batches:
            if not batch.num_rows:
                continue
            for part, counts in zip(batch.column(0).to_pylist(), _popcounts(batch), strict=True):
                held[part] = held[part] + counts if part in held else counts
            if len(held) >= HELD_PARTS:
                yield out()
                held.clear()
        if held:
            yield out()

    found = index.mapInArrow(freed(run), COUNTS_DDL)
    return found.groupBy("part", "first").agg(*[F.sum(c).alias(c) for c in ("kept", *LABELS)])


def _steps() -> str:
    """Every step of every order, as JSON: the filters before it as bits, and its own."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for number, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            steps.append({"filter_order": "".join(order), "step": number, "before": before, "own": own})
            before |= own
    return json.dumps(steps)


def interactions(counts: DataFrame) -> DataFrame:
    """prefix_counts() read along all orders of the filters: a row per part, order and step."""
    # 32 sets a part, so the lists are of fixed length.
    lists = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("first", "kept", *LABELS))).alias("n"))
    step = F.from_json(F.lit(_steps()), "array<struct<filter_order string, step int, before int, own int>>")
    rows = lists.select("part", "n", F.inline(step))
    at = lambda s, what: F.get("n", s)[what]
    before, after, none = F.col("before"), F.col("before") + F.col("own"), F.lit(0)
    others = F.lit(SETS - 1) - F.col("own")
    removed = at(before, "kept") - at(after, "kept")
    out = rows.select(
        "part",
        "filter_order",
        "step",
        at(after, "kept").alias("kept"),
        removed.alias("removed"),
        (at(none, "kept") - at(F.col("own"), "kept") - removed).alias("redundant"),
        (at(others, "kept") - at(F.lit(SETS - 1), "kept")).alias("unique_fails"),
        *[(at(before, x) - at(after, x)).alias(f"{x}_lost") for x in LABELS],
        F.col("own").alias("_own"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "_own"))  # 120 rows each
    return out.withColumn("shapley", total).drop("_own")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does to docs (doc_id, text, lang) in each order, by part (lang), with the labelled documents it costs.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Null text is
    empty; null lang is the part ''. Rows with one doc_id are documents of their own, and of equal texts those with the
    smallest id pass filter E; a null id passes it. A document with several labels has each that any of them gives. An empty
    table has no parts and gives no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        counts = staged(prefix_counts(bitmap_index(judged(docs, labels))), "audit-counts", lasting=True)
    return interactions(counts)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents; nulls, ties and repeats as in audit()."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first THEN 16 ELSE 0 END AS fails
  FROM d JOIN f ON d.text = f.text LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM j GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS own, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN fails & (before + own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & before > 0 AND fails & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM g, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
