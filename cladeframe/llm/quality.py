"""Quality by weak labels: overlapping heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Each labeller says good, bad or nothing about a text. Expectation-maximisation over the counts of all vote
patterns estimates how often each labeller says what of good and of bad texts; the posterior of a
text's votes is its label. A linear scorer over hashed features learns those labels and scores every text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import freed, need
from cladeframe.llm.tokens import in_slices

#: Rows the scorer is fitted on at most; the label model uses the votes on all rows.
FIT_ROWS = 4000
BUCKETS = 1 << 14
EPOCHS, RATE, DECAY = 30, 0.5, 1e-5
STEPS = 60
BAD, GOOD, NONE = 0, 1, 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:'\"-()?!"]] = True
#: Letters and digits by kind; runs of one kind are then written once.
_KIND = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else 48 if 48 <= c < 58 else 10 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))

STATS = ("words", "symbols", "upper", "digits", "repeats", "top", "lines", "squeeze", "length", "shout", "bars", "marked")
#: Of each labeller the statistic, the bound from which it says bad, and the bound up to which it says good.
LABELLERS = (
    ("symbols", 0.05, 0.005),
    ("upper", 0.4, 0.12),
    ("digits", 0.25, 0.03),
    ("repeats", 0.15, 0.03),
    ("top", 0.35, 0.18),
    ("lines", 0.3, 0.02),
    ("squeeze", 0.72, 0.66),
    ("length", 0.45, 0.25),
    ("shout", 0.12, 0.03),
    ("bars", 0.1, 0.0),
    ("marked", 0.25, 0.02),
)


def statistics(text: bytes, words: list[bytes]) -> tuple[float, ...]:
    """The numbers that labellers look at, each larger the stranger the text."""
    codes = np.frombuffer(text, np.uint8)
    n = max(len(codes), 1)
    letters = max(int(_LETTER[codes].sum()), 1)
    plain = _LETTER[codes] | _DIGIT[codes] | _SPACE[codes] | _COMMON[codes]
    total = max(len(words), 1)
    marked = len(np.unique(np.cumsum(_SPACE[codes])[~plain])) / total
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / total
    top = Counter(words).most_common(1)[0][1] / total if len(words) >= 20 else 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0.0
    squeeze = 1 - len(zlib.compress(text, 1)) / n if n >= 200 else 0.5
    mean = (n - total) / total
    return (
        float(np.log2(total + 1)),
        1 - float(plain.sum()) / n,
        float(_UPPER[codes].sum()) / letters,
        float(_DIGIT[codes].sum()) / n,
        repeats,
        top,
        again,
        squeeze,
        abs(mean - 6.0) / 14.0,
        (text.count(b"!") + text.count(b"?")) / total,
        (text.count(b"|") + text.count(b"\t") + text.count(b"{") + text.count(b"<")) / total,
        marked,
    )


def votes(stats: np.ndarray) -> np.ndarray:
    """One vote per labeller: BAD, GOOD or NONE."""
    out = np.full((len(stats), len(LABELLERS)), NONE, np.int8)
    for k, (name, bad, good) in enumerate(LABELLERS):
        x = stats[:, STATS.index(name)]
        out[x <= good, k] = GOOD
        out[x >= bad, k] = BAD
    return out


@dataclass
class Labels:
    """The label model: the share of good texts, and of each labeller the log-odds that a vote adds."""

    prior: float = 0.5
    says: np.ndarray = field(default_factory=lambda: np.full((len(LABELLERS), 2, 3), 1 / 3))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good."""
        k = np.arange(len(LABELLERS))
        odds = np.log(self.prior / (1 - self.prior)) + np.log(self.says[k, 1, v] / self.says[k, 0, v]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> Labels:
    """EM over distinct vote patterns and their counts; starts at the votes' balance, where one bad vote weighs as two good ones."""
    model = Labels()
    if not len(patterns):
        return model
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    p = 1 / (1 + np.exp(-(0.5 * good - 3.0 * bad)))
    total = counts.sum()
    for _ in range(steps):
        w = np.stack([counts * (1 - p), counts * p])
        model.prior = float(np.clip(w[1].sum() / total, 0.01, 0.99))
        for k in range(len(LABELLERS)):
            for c in (0, 1):
                seen = np.bincount(patterns[:, k], weights=w[c], minlength=3) + 0.1
                model.says[k, c] = seen / seen.sum()
        p = model.posterior(patterns)
    return model


def features(text: bytes, words: list[bytes], stats: tuple[float, ...]) -> np.ndarray:
    """Sorted hashed features: shapes of words, pairs of shapes, and the statistics by step."""
    codes = np.frombuffer(text.translate(_KIND), np.uint8)
    keep = np.ones(len(codes), bool)
    keep[1:] = codes[1:] != codes[:-1]
    shapes = codes[keep].tobytes().split()
    ids = np.array([zlib.crc32(s) for s in shapes], np.uint64)
    pairs = ids[:-1] * np.uint64(0x9E3779B1) + ids[1:]
    steps = np.array([zlib.crc32(f"{k}:{int(x * 20)}".encode()) for k, x in enumerate(stats)], np.uint64)
    every = np.unique(np.concatenate([ids, pairs, steps])) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((every >> np.uint64(50)).astype(np.int64))


def described(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray]:
    words = [t.split() if t else [] for t in texts]
    return words, np.array([statistics(t or b"", w) for t, w in zip(texts, words, strict=True)])


@dataclass
class Scorer:
    labels: Labels
    weights: np.ndarray

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of the labellers and score of the linear model; texts without a word have 0 of both."""
        words, stats = described(texts)
        posterior = self.labels.posterior(votes(stats))
        z = np.array([self.weights[f].sum() / np.sqrt(max(len(f), 1)) for f in (features(t or b"", w, tuple(s)) for t, w, s in zip(texts, words, stats, strict=True))])
        empty = np.array([not w for w in words])
        score = 1 / (1 + np.exp(-np.clip(z + self.weights[-1], -50, 50)))
        return np.where(empty, 0.0, posterior), np.where(empty, 0.0, score)


def fit_scorer(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad, over sparse rows; the last weight is the bias."""
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f = rows[i]
            scale = 1 / np.sqrt(max(len(f), 1))
            p = 1 / (1 + np.exp(-np.clip(weights[f].sum() * scale + weights[-1], -50, 50)))
            g = p - target[i]
            step = g * scale + DECAY * weights[f]
            seen[f] += step * step
            weights[f] -= RATE * step / np.sqrt(seen[f])
            seen[-1] += g * g
            weights[-1] -= RATE * g / np.sqrt(seen[-1])
    return weights


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """Votes of all documents are counted by pattern on the executors (3**11 patterns at most); the scorer is fitted
    on the driver on at most fit_rows documents, chosen by a hash of id and text."""
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for _, some in in_slices(batch.column(0)):
                words, stats = described(some)
                found.update(v.tobytes() for v, w in zip(votes(stats), words, strict=True) if w)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    got = texts.select("text").mapInArrow(freed(count), "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns = np.array([np.frombuffer(bytes(r["pattern"]), np.int8) for r in got]) if got else np.zeros((0, len(LABELLERS)), np.int8)
    counts = np.array([r["n"] for r in got], float)
    labels = fit_labels(patterns, counts)
    # By a hash of id and text: rows that share an id, or have none, aren't drawn together; equal rows count once.
    share = min(1.0, fit_rows / max(counts.sum(), 1.0))
    sample = texts.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.col("h").bitwiseAND(F.lit((1 << 40) - 1)) < F.lit(int(share * (1 << 40)) + 1))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in in_slices(batch.column(1)):
                words, stats = described(some)
                post = labels.posterior(votes(stats))
                rows = [features(t, w, tuple(s)).astype(np.int32).tobytes() for t, w, s in zip(some, words, stats, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), pa.array(rows, pa.binary()), pa.array(post)], names=["h", "features", "posterior"])

    fitted = sample.mapInArrow(freed(sparse), "h long, features binary, posterior double").dropDuplicates(["h"]).orderBy("h").limit(fit_rows).collect()
    weights = fit_scorer([np.frombuffer(bytes(r["features"]), np.int32) for r in fitted], np.array([r["posterior"] for r in fitted]))
    return Scorer(labels, weights)


def score(docs: DataFrame, model: Scorer | None = None) -> DataFrame:
    """doc_id, posterior, quality (0 to 1), keep (quality of one half or more) of every row.

    Null texts and texts without a word have quality 0. Repeated rows are scored each; other columns are
    ignored; an empty table gives an empty result. Whole texts; no shuffle.
    """
    need(docs, "doc_id", "text")
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_slices(batch.column(1)):
                posterior, quality = model.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(posterior), pa.array(quality), pa.array(quality >= 0.5)], names=["doc_id", "posterior", "quality", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, posterior double, quality double, keep boolean")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, quality and keep of every document; null, empty and repeated rows as in score()."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
