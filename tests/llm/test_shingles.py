import random

import corpus_pipeline
import pytest

from cladeframe.llm import shingles as J
from cladeframe.llm import simhash

from .conftest import prose


def brute_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute_groups(rows):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    """Copies at a similarity of about 0.7 to 0.97, a crowd of copies of one text, boilerplate, short and empty texts."""
    r = random.Random(7)

    def changed(text, n):
        w = text.split()
        for i in r.sample(range(len(w)), n):
            w[i] = f"new{r.randrange(10**6)}"
        return " ".join(w)

    texts = []
    for k in range(30):
        base = prose(1000 + k, 120 + 10 * k)
        texts += [base, *[changed(base, n) for n in (1, 2, 3, 4, 6, 8)]]
    crowd = prose(5000, 200)
    texts += [changed(crowd, r.randrange(1, 6)) for _ in range(60)]
    notice = prose(6000, 60)
    texts += [notice + " " + prose(6001 + k, 8 + k) for k in range(40)]
    texts += [None, "", " \t", "one", "One", "a b c d e", "a b c d e f", "a b c d e f g h i", "a b c d e f g h i j"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_groups_are_those_of_brute_force(spark, rows):
    want = sorted((i, c) for (i, _), c in zip(rows, brute_groups(rows), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for small, index in ((J.SMALL, None), (4, None), (4, lambda fps: simhash.links(fps, 8))):
        assert sorted((r.doc_id, r.component_id) for r in J.similar_groups(df, small=small, index=index).collect()) == want
    assert J.similar_groups(df.limit(0)).count() == 0


def test_the_stage_drops_copies_from_a_similarity_of_four_fifths(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for (i, _), c in zip(rows, brute_groups(rows), strict=True) if i == c})


def test_shingles_of_all_rows_are_counted(spark):
    """50,000 rows: a passage is in each tenth of them, so its bucket has just so many more than others; none is left to a sample."""
    often = "one passage that many share"
    texts = [(i, often if i % 10 == 0 else f"row {i}") for i in range(50_000)]
    counts = J.shingle_counts(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), 5)
    assert counts.sum() == 50_000
    bucket = int(J.shingle_set(often.encode(), 5)[0]) & (J.BUCKETS - 1)
    others = [int(J.shingle_set(t.encode(), 5)[0]) & (J.BUCKETS - 1) for i, t in texts if i % 10]
    assert counts[bucket] == 5_000 + others.count(bucket)
