"""Language identification by nearest centroid.

Letters of a text give hashed character n-grams; their TF-IDF vectors, normalised, are compared by
cosine with several clustered centroids per language. A text too far from every centroid, for its
length, is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import BROADCAST_IDS, by_ids, freed, fresh, need, scratch, staged
from cladeframe.llm.tokens import in_slices

BUCKETS = 1 << 13
#: Labelled rows a language that its centroids are clustered from, as expected; n-gram counts are over all rows.
FIT_ROWS = 400
CLUSTERS, STEPS = 3, 10
#: A cluster with a smaller share of its language's fitted rows is taken for junk or wrong labels and has no centroid.
LEAST_SHARE = 0.08
#: Every so many-th fitted row is held out of the clustering and calibrates the rejection.
CALIBRATE = 4
#: A text is rejected below REJECT times the cosine that a share of 1 - LOW of the calibrating rows of its length and language
#: exceed. A low quantile, unlike the least, isn't moved by a few rows of junk that bear a language's label.
REJECT, LOW = 0.5, 0.1
#: Calibrating rows of a length (by its power of two) from which on distances count.
ENOUGH = 20
#: Texts under 2**SHORT letters, and lengths without calibrating rows, are rejected below this cosine only.
BARE, SHORT = 0.05, 5
#: No more than this many times FIT_ROWS rows of a language are ever fitted, whatever their ids and texts.
FIT_MOST = 2
#: Labels that centroids are learned for, those with the most rows; others are taken for errors.
MOST_LANGUAGES = 1000
#: Texts vectorised at once, and about their bytes: dense counts take 64 KB a text, n-grams some 80 bytes a character.
SLICE, SLICE_BYTES = 128, 1 << 18
#: Digests of rejected texts that are broadcast at most: an eighth of the ids that may be, as each takes some 100 bytes.
BROADCAST_DIGESTS = BROADCAST_IDS // 8
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the counts of its hashed 2- and 3-grams (rows of BUCKETS), and its number of letters.

    Other characters than letters part words; a run of them counts as one space.
    """
    codes, owner = [], []
    for i, t in enumerate(texts):
        c = np.frombuffer(f" {t.decode('utf-8', 'replace').lower() if t else ''} ".encode("utf-32-le", "replace"), np.uint32)
        codes.append(c)
        owner.append(np.full(len(c), i, np.int64))
    c, own = np.concatenate(codes), np.concatenate(owner)
    letter = _is_letter()[c]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (own[1:] != own[:-1])
    c, own, letter = np.where(letter, c, 0)[keep].astype(np.uint64), own[keep], letter[keep]
    n = len(texts)
    letters = np.bincount(own[letter], minlength=n)
    # A space that starts a text follows the one that ends the text before: no n-gram spans both.
    two_ok = (own[1:] == own[:-1]) & (letter[1:] | letter[:-1])
    two = c[:-1] * np.uint64(0x1F0D1) + c[1:]
    three = two[:-1] * np.uint64(0x1F0D1) + c[2:]
    three_ok = two_ok[:-1] & two_ok[1:]
    grams = np.concatenate([two[two_ok], three[three_ok] ^ np.uint64(1 << 60)]) * np.uint64(0x9E3779B97F4A7C15)
    at = np.concatenate([own[:-1][two_ok], own[:-2][three_ok]]) * BUCKETS + (grams >> np.uint64(64 - 13)).astype(np.int64)
    return np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS), letters


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


@dataclass
class Centroids:
    languages: list[str] = field(default_factory=list)
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    points: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    idf: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS, np.float32))
    floor: np.ndarray = field(default_factory=lambda: np.zeros((1, 32), np.float32))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores from 0 to 1, and which texts are rejected."""
        counts, letters = gram_counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(counts, self.idf) @ self.points.T
        best = cosine.argmax(axis=1)
        none = letters == 0
        score = np.where(none, 0.0, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)).astype(np.float64)
        names = [UNKNOWN if z else self.languages[self.owner[b]] for z, b in zip(none.tolist(), best.tolist(), strict=True)]
        return names, score, none | (score < self.floor[self.owner[best], band(letters)])


def band(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), 31)


def clusters(x: np.ndarray, k: int, steps: int) -> np.ndarray:
    """Spherical k-means; starts at the vector nearest to the mean and then at those farthest from the chosen, of the nearer half."""
    middle = x @ x.mean(axis=0)
    outer = middle < np.median(middle)
    chosen = [int(middle.argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.where(outer, 2.0, (x @ x[chosen].T).max(axis=1)).argmin()))
    points = x[chosen]
    for _ in range(steps):
        nearest = (x @ points.T).argmax(axis=1)
        new = np.stack([x[nearest == j].sum(axis=0) if (nearest == j).any() else points[j] for j in range(len(points))])
        points = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    held = np.bincount((x @ points.T).argmax(axis=1), minlength=len(points))
    return points[held >= min(LEAST_SHARE * len(x), held.max())].astype(np.float32)


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS, k: int = CLUSTERS) -> Centroids:
    """Learn from the columns key (any), text and lang of rows with a lang.

    Document frequencies of n-grams are over all rows, summed by n-gram on the executors. The centroids are
    clustered on the driver from a sample of expected fit_rows rows a language, and FIT_MOST times that at most, taken by
    a hash of key and text, for the MOST_LANGUAGES labels with the most rows; the driver holds the sample's sparse vectors.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("key"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, texts in in_slices(batch.column(0), SLICE_BYTES, SLICE):
                counts, _ = gram_counts(texts)
                total += (counts > 0).sum(axis=0)
                n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(total, n))], names=["bucket", "n"])

    spark = labelled.sparkSession
    with scratch(spark):
        counted = rows.select("text").mapInArrow(freed(frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        found = staged(counted, "gram-rows", texts=True).collect()
    df = np.zeros(BUCKETS + 1)
    for r in found:
        df[r["bucket"]] = r["n"]
    model = Centroids()
    if df[BUCKETS] == 0:
        return model
    model.idf = np.log1p(df[BUCKETS] / (1 + df[:BUCKETS])).astype(np.float32)
    hashed = rows.withColumn("part", F.xxhash64("key", "text").bitwiseAND(F.lit((1 << 40) - 1)))
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("part").alias("least")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()
    # The row with the least hash is always taken: a language that repeats a few rows is learned too.
    shares = [(r["lang"], max(r["least"], min(1 << 40, math.ceil((1 << 40) * fit_rows / r["n"])) - 1)) for r in sizes]
    # From an Arrow table the rows reach the executors without a Python worker, of which Spark would keep some beside those of mapInArrow.
    names, least = zip(*shares, strict=True)
    shared = F.broadcast(spark.createDataFrame(pa.table({"lang": pa.array(names, pa.string()), "share": pa.array(least, pa.int64())})))
    first_rows = F.row_number().over(Window.partitionBy("lang").orderBy("part", "key"))
    picked = hashed.join(shared, "lang").where("part <= share").withColumn("rank", first_rows).where(F.col("rank") <= FIT_MOST * fit_rows)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for first, texts in in_slices(batch.column(1), SLICE_BYTES, SLICE):
                counts, letters = gram_counts(texts)
                packed = [(at := np.flatnonzero(row)).astype(np.int32).tobytes() + row[at].astype(np.int32).tobytes() for row in counts]
                yield pa.RecordBatch.from_arrays([langs.slice(first, len(texts)), pa.array(letters), pa.array(packed, pa.binary())], names=["lang", "letters", "packed"])

    with scratch(spark):
        sample = staged(picked.select("lang", "text").mapInArrow(freed(sparse), "lang string, letters long, packed binary"), "fitted-rows", texts=True).orderBy("lang", "packed").collect()
    by: dict[str, list] = {}
    for r in sample:
        if r["letters"]:
            by.setdefault(r["lang"], []).append((r["letters"], np.frombuffer(r["packed"], np.int32).reshape(2, -1)))
    points, owner, nearness = [], [], []
    for name in sorted(by):
        counts = np.zeros((len(by[name]), BUCKETS), np.int32)
        for i, (_, (at, n)) in enumerate(by[name]):
            counts[i, at] = n
        x = vectors(counts, model.idf)
        held = np.arange(len(x)) % CALIBRATE == CALIBRATE - 1
        own = clusters(x[~held], k, STEPS)
        points.append(own)
        owner += [len(model.languages)] * len(own)
        model.languages.append(name)
        nearness.append((band(np.array([n for n, _ in by[name]]))[held], (x[held] @ own.T).max(axis=1)))
    model.owner, model.points, model.floor = np.array(owner), np.concatenate(points), floors(nearness)
    return model


def floors(nearness: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each language and length (power of two of its letters) the cosine below which a text is rejected.

    nearness: for each language the lengths and cosines of its calibrating rows. A length's quantile is over all
    languages, and a language has a factor for how far its rows lie below that.
    """
    out = np.full((max(len(nearness), 1), 32), BARE, np.float32)
    out[:, :4] = 0.0
    bands, cosine = (np.concatenate([n[k] for n in nearness]) if nearness else np.zeros(0) for k in (0, 1))
    usual, known = np.zeros(32), np.zeros(32, bool)
    for b in range(SHORT, 32):
        here = cosine[bands == b]
        known[b] = len(here) >= ENOUGH
        # A length that few rows have goes by the next shorter one that is known.
        usual[b] = np.quantile(here, LOW) if known[b] else usual[b - 1]
    for k, (own, cos) in enumerate(nearness):
        some = usual[own] > 0
        factor = min(1.0, np.quantile(cos[some] / usual[own[some]], LOW)) if some.sum() >= ENOUGH else 1.0
        out[k] = np.where(usual > 0, REJECT * factor * usual, out[k])
    return out


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row, from its text alone.

    Null texts and texts without a letter are `und`, score 0, rejected. With nothing learned all are.
    Ties go to the first language by name. Whole texts; no shuffle.
    """
    need(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_slices(batch.column(1), SLICE_BYTES, SLICE):
                names, score, rejected = model.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(key: Column) -> Column:
    """True for a fifth of the keys, by CRC-32 of their text; a null key is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_on_documents(docs: DataFrame) -> Centroids:
    return train(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))


def keep_known(docs: DataFrame, model: Centroids | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language isn't rejected. Null and letterless texts go.

    A text alone decides, so the rejected ones are staged by their SHA-256 and the rows are anti-joined with those: texts go to
    Python workers in bounded batches, whoever writes the result, and don't come back.
    """
    model = model or train_on_documents(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in in_slices(batch.column(1), SLICE_BYTES, SLICE):
                gone = batch.column(0).slice(first, len(some)).filter(pa.array(model.predict(some)[2]))
                if len(gone):
                    yield pa.RecordBatch.from_arrays([gone], names=["gone"])

    text, name = F.col("text").cast("string").cast("binary"), fresh(docs, "digest_")
    some = docs.where(F.col("text").isNotNull())
    digest = F.unhex(F.sha2(text, 256))
    gone = staged(some.select(digest.alias("digest"), text.alias("text")).mapInArrow(freed(run), "gone binary").distinct(), "rejected", texts=True)
    return by_ids(some.withColumn(name, digest), gone, "left_anti", name, BROADCAST_DIGESTS).drop(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document's whole text; null, empty and letterless texts are `und` with score 0,
    ties go to the first language by name, repeated rows are returned each, an empty table gives no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train_on_documents(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
