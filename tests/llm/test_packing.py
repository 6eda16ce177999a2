import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cladeframe.llm import packing as P
from cladeframe.llm.tokens import ChunkIds, default_tokenizer
from cladeframe.stage import BATCH_BYTES, TEXT_BATCH


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def test_ids_are_those_of_whole_texts(tokenizer):
    r = random.Random(0)
    odd = list("aAbSs'tT.,!*&<|> \n\t\x1c\x01éÉßΣςİǰJ̌́K1２½ 　_-\U0001f600") + ["<|endoftext|>", "'ll", "I'm "]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t, ids in zip(texts, ChunkIds(default_tokenizer()).ids([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_forgetting_changes_no_ids(tokenizer, monkeypatch):
    monkeypatch.setattr("cladeframe.llm.tokens.REMEMBERED", 3)
    e = ChunkIds(default_tokenizer())
    for t in ("one two three four", "two three five", "one six two, two", "nine two."):
        assert e.ids([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces_and_packing(docs, texts, tokenizer):
    rows = P.pack(P.token_pieces(docs, capacity=256), capacity=256, group=16).collect()
    want = []
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), 256)):
            own = ids[start : start + 256]
            want.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(r.length for r in rows) // 256)
    assert least <= len(bins) <= 1.05 * least + 1


def test_crossover_keeps_every_item_once():
    r = random.Random(1)
    lengths = [r.randint(1, 100) for _ in range(300)]
    people = P.first_population(lengths, 128, 4, random.Random(2))
    for _ in range(20):
        child = P.crossover(people[0], people[-1], r)
        assert sorted(i for b in child.bins for i in b) == list(range(300))
        assert child.room == [128 - sum(lengths[i] for i in b) for b in child.bins]
        assert min(child.room) >= 0


def test_generations_beat_best_fit_and_never_lose_to_it():
    better = 0
    for seed in range(20):
        r = random.Random(seed)
        lengths = [r.randint(20, 60) for _ in range(120)]
        first = P.first_population(lengths, 128, P.POPULATION, random.Random(seed))
        best = P.evolve(first, 40, random.Random(seed))[0]
        assert best.worth() >= first[0].worth()
        better += len(best.bins) < len(first[0].bins)
    assert better >= 3


def test_every_group_crosses_over(monkeypatch):
    """Also where best fit already needs no more bins than the lengths' sum allows."""
    count = []
    real = P.crossover
    monkeypatch.setattr(P, "crossover", lambda *a: count.append(1) or real(*a))
    start = P.pa.table({"grp": [7], "island": P.pa.array([0], "int32"), "lengths": [[1] * 50], "people": P.pa.array([[]], P.pa.list_(P.pa.list_(P.pa.int32())))})
    out = P._island_round(10, 0, 2, 3, 5, False)(start)
    assert len(count) == 6
    assert out.column("island").to_pylist() == [0, 1]  # itself, and its best for the next island
    met = P._island_round(10, 1, 2, 3, 5, True)(out.set_column(1, "island", P.pa.array([1, 1], "int32")))
    assert len(count) > 6
    assert len(set(met.column("people").to_pylist()[0][0])) == 5


def test_no_documents(no_docs):
    assert P.pack(P.token_pieces(no_docs)).count() == 0


@pytest.mark.parametrize("lengths", [[2100] * 300, [3000] * 150 + [2100] * 150, [2100, 1990] * 200])
def test_lengths_that_fill_no_bin_take_few_levels(spark, monkeypatch, lengths):
    levels = []
    kept = P._pack_level
    monkeypatch.setattr(P, "_pack_level", lambda *a: (levels.append(a[2]), kept(*a))[1])
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], P.PIECE_SCHEMA)
    got = P.pack(pieces, group=64, rounds=1, generations=1).collect()
    assert len(got) == len(lengths) and len(levels) <= 4
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= P.CAPACITY
    most = len(lengths) if min(lengths) > P.CAPACITY // 2 else len(lengths) // 2 + len(lengths) // 50
    assert len(bins) <= most


def test_texts_reach_workers_in_bounded_batches(spark):
    """10 MB of texts in one partition: their pieces are made from batches of some 4 MB, and the session's setting stays."""
    before = spark.conf.get(BATCH_BYTES)
    texts = spark.range(0, 100, 1, 1).selectExpr("id AS doc_id", "repeat('x', 100000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [batch.nbytes], "piece": pa.array([0], pa.int32()), "start": [0], "length": [1], "ids_crc32": [0]})

    got = [r.doc_id for r in P.pack(texts.mapInArrow(sizes, P.PIECE_SCHEMA)).collect()]
    assert sum(got) > 10_000_000 and max(got) < TEXT_BATCH + 200_000
    assert spark.conf.get(BATCH_BYTES) == before
