import random

from cladeframe.llm import decontaminate as D

from .conftest import prose


def test_passages_are_found_with_words_changed(spark, docs, no_docs):
    r = random.Random(0)
    rare = lambda n, k: " ".join("".join(random.Random(f"{n}{k}{i}").choices("bcdfglmnprstaeiou", k=6)) for i in range(n))
    items = [(k, rare(20 + k % 17, k)) for k in range(30)] + [(99, None), (98, ""), (97, "too short"), (96, rare(8, 77)), (5, rare(30, 500))]
    rows, want = [], set()
    for d in range(300):
        own = prose(d, 120).split()
        if d % 3 == 0:
            k = d % 30
            passage = items[k][1].split()
            if d % 2:
                for i in range(3, len(passage), 9):
                    passage[i] = "changed"
            at = r.randint(0, len(own))
            own[at:at] = [w.upper() + "," if i % 5 == 0 else w for i, w in enumerate(passage)]
            want.add((d, k))
        if d % 50 == 1:
            own[7:7] = items[d % 30][1].split()[:9]  # nine words of an item of twenty or more are no overlap
        rows.append((d, " ".join(own), d))
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, at int")
    found = D.contaminated(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want
    assert all(x.similarity >= 0.8 and x.end - x.start >= 13 for x in found)
    kept = D.keep_clean(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {d for d, _, _ in rows} - {d for d, _ in want}
    short = spark.createDataFrame([(1, "x y " + items[-2][1] + " z"), (None, items[0][1])], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in D.contaminated(short, bench).collect()} == {(1, 96), (None, 0)}
    assert D.contaminated(docs, bench).count() == 0 and D.contaminated(no_docs, bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_join_without_broadcast_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string")
    df = spark.createDataFrame([(1, "so " + prose(900, 40)), (2, prose(901, 60))], "doc_id long, text string")
    assert [(x.doc_id, x.item_id) for x in D.contaminated(df, bench).collect()] == [(1, 1)]


def test_overlap_needs_its_share():
    import numpy as np

    item = np.arange(20, dtype=np.int64)
    doc = item.copy()
    doc[[3, 9, 15]] = -1
    assert D.best_overlap(doc, item, 0) == (0, 20, 17 / 20)
    doc[::3] = -1
    assert D.best_overlap(doc, item, 0) is None


def test_short_items_against_brute_force(spark):
    """Items of one to eight words, met whole or with one word changed."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    docs = [(d, " ".join(r.choice(words) for _ in range(r.randint(0, 25)))) for d in range(120)]
    items = [(n * 10 + k, " ".join(r.choice(words) for _ in range(n))) for n in range(1, 9) for k in range(5)]

    def met(doc, item):
        return any(sum(a == b for a, b in zip(doc[i : i + len(item)], item, strict=True)) >= D.SIMILARITY * len(item) for i in range(len(doc) - len(item) + 1))

    want = {(d, k) for d, t in docs for k, x in items if met(t.split(), x.split())}
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(want) > 100
