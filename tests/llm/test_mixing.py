import hashlib
import re
from collections import defaultdict
from fractions import Fraction
from math import floor

import duckdb
import pytest

from cladeframe.llm import mixing
from cladeframe.llm.registry import ORACLES, QUERIES
from tests.test_queries import DATA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), most=3):
    """Rounds of resharing, in exact numbers. sizes: source -> words."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = Fraction(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: Fraction(most * sizes[s]) if s in capped else weight[s] * level for s in names}
        capped |= over


def start(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def brute(docs):
    """docs: (doc_id, source, text); balanced draws."""
    sized = [(i, s, len(WORD.findall(t or ""))) for i, s, t in docs]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    want = targets(sizes)
    out = []
    for s in sizes:
        rate = float(want[s]) / sizes[s] if sizes[s] else 0.0
        whole, part = floor(rate), rate - floor(rate)
        u = start("mix:" + (s or ""))
        own = sorted((d for d in sized if d[1] == s), key=lambda d: (d[2], hashlib.md5(str(d[0] if d[0] is not None else "").encode()).hexdigest()))
        for r, (i, _, n) in enumerate(own):
            c = whole + (floor(part * (r + 1) + u) > floor(part * r + u))
            out.append((i, s, n, sizes[s], round(float(want[s]), 6), n * c))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def test_against_brute_force(spark, docs):
    got = as_rows(mixing.mixture(docs))
    assert got == brute([(r.doc_id, r.source, r.text) for r in docs.collect()])


def test_bounds_of_small_sources(spark):
    rows_ = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 4), ("a", 6), ("b", 1000), ("c", 3), (None, 50), ("é", 200), ("", 0), ("z", 900)] * 3)]
    docs = spark.createDataFrame(rows_, "doc_id long, source string, text string")
    got = mixing.mixture(docs).collect()
    assert as_rows(spark.createDataFrame(got)) == brute(rows_)
    assert any(r.target == 3 * r.source_size > 0 for r in got), "a source stops at its bound"
    assert all(r.taken <= 3 * r.size for r in got)
    by = {r.source: r.target for r in got}
    assert sum(by.values()) == pytest.approx(sum(r.size for r in got))


def near(rows_, most):
    taken, sizes = defaultdict(int), defaultdict(int)
    for r in rows_:
        taken[r.source] += r.taken
        sizes[r.source] = max(sizes[r.source], r.size)
    target = {r.source: r.target for r in rows_}
    return all(abs(taken[s] - target[s]) <= most * sizes[s] for s in target)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = mixing.mixture(docs).collect()
    assert near(one, 1.5) and all(r.taken <= 3 * r.size for r in one)
    again = mixing.mixture(docs.repartition(5)).collect()
    assert sorted(one) == sorted(again), "a rerun over other partitions agrees"


def test_independent_draws_have_the_same_rates(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "w " * (1 + i % 7)) for i in range(6000)], "doc_id long, source string, text string")
    got = mixing.mixture(docs, balanced=False).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.08)
        rate = own[0].target / own[0].source_size
        assert {r.copies for r in own} == {floor(rate), floor(rate) + 1}


def test_too_many_sources_to_broadcast(spark, docs, monkeypatch):
    want = as_rows(mixing.mixture(docs))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert as_rows(mixing.mixture(docs)) == want


def test_empty_table_and_texts_without_words(spark, docs, no_docs):
    assert mixing.mixture(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, "b", " \t ")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.mixture(blank).collect()] == [(0.0, 0), (0.0, 0)]
    with pytest.raises(ValueError, match="source"):
        mixing.mixture(docs.drop("source"))


def test_the_mix_itself(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "w " * (5 + i % 3), "mine") for i in range(60)], "doc_id long, source string, text string, copy string")
    plan = {r.doc_id: r.copies for r in mixing.mixture(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == ["doc_id", "source", "text", "copy", "copy_"]
    found = defaultdict(list)
    for r in got.collect():
        found[r.doc_id].append(r.copy_)
        assert r.copy == "mine"
    assert {i: sorted(c) for i, c in found.items()} == {i: list(range(1, n + 1)) for i, n in plan.items() if n}
    with pytest.raises(ValueError, match="repeat"):
        mixing.mixed(docs.union(docs))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_same_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    got, want = QUERIES["op12_mixing"](spark, str(DATA)).toPandas(), con.sql(ORACLES["op12_mixing"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
