import random

import numpy as np
import pyarrow as pa
import pytest

from cladeframe.llm import langid, quality
from cladeframe.llm.common import staged

from .conftest import prose

LANGUAGES = {"aa": ["ba", "be", "bi", "ter", "lon"], "cc": ["cha", "sto", "gri", "ump", "ol"], "ee": ["éla", "vou", "ñan", "ix", "qué"]}


def text(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(LANGUAGES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_languages_of_held_out_documents(spark, docs, no_docs):
    rows = [(i, text(lang, i), lang, 1) for i in range(90) for lang in LANGUAGES]
    rows = [(k, t, lang, x) for k, (_, t, lang, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train_on_documents(df)
    assert model.languages == sorted(LANGUAGES) and 3 <= len(model.points) <= 9
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = {r.doc_id for r in df.where(langid.held_out(df.doc_id)).select("doc_id").collect()}
    assert 0.1 < len(held) / len(rows) < 0.3
    assert all(got[k].lang_pred == lang and 0 < got[k].score <= 1 and not got[k].rejected for k, _, lang, _ in rows if k in held)
    odd = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 - 34"), (4, "Привет как дела друзья мои хорошие"), (5, "ba")], "doc_id long, text string"), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and odd[i].rejected for i in (1, 2, 3))
    assert odd[4].rejected and not odd[5].rejected and odd[5].lang_pred in LANGUAGES
    assert langid.predict(docs, model).count() == docs.count()
    assert langid.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train_on_documents(no_docs)).collect()} == {"und"}
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows)


@pytest.mark.parametrize("most", [langid.BROADCAST_DIGESTS, 0])
def test_rejected_texts_go_whoever_writes_the_result(spark, monkeypatch, most):
    """Workers get texts in bounded batches where rejected ones are staged, none where the result is written; each row goes by its own text."""
    rows = [(k, text(lang, k), lang, b"x") for k in range(60) for lang in ("aa", "cc")]
    model = langid.train_on_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, digest_ binary"))
    odd = [(1, None), (2, ""), (3, "12 - 34"), (3, rows[0][1]), (3, rows[0][1]), (None, rows[1][1]), (None, "?!"), (4, "Привет как дела друзья мои хорошие"), (5, "?!"), (6, "a" * 5000 + rows[2][1])]
    df = spark.createDataFrame([(i, t, "aa", b"x") for i, t in odd], "doc_id long, text string, lang string, digest_ binary").repartition(3)
    bounded = []
    monkeypatch.setattr(langid, "staged", lambda df, tag, texts=False: (bounded.append(texts), staged(df, tag, texts=texts))[1])
    monkeypatch.setattr(langid, "BROADCAST_DIGESTS", most)
    kept = langid.keep_known(df, model)
    assert bounded == [True] and "MapInArrow" not in kept._jdf.queryExecution().toString() and kept.schema == df.schema
    told = {t: r for _, t in odd if t for r in model.predict([t.encode()])[2].tolist()}
    assert not told[rows[0][1]] and told["?!"] and told["Привет как дела друзья мои хорошие"]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, ((i, t) for i, t in odd if t and not told[t])))


def test_learning_needs_bounded_batches_and_one_kind_of_python_worker(spark, monkeypatch):
    """Rows made from a Python list pass through workers of their own, which Spark keeps beside those of mapInArrow; an Arrow table's don't."""
    df = spark.createDataFrame([(k, text(lang, k), lang) for k in range(20) for lang in ("aa", "cc")], "doc_id long, text string, lang string")
    made, bounded, make = [], [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (made.append(type(data)), make(self, data, *a, **k))[1])
    monkeypatch.setattr(langid, "staged", lambda df, tag, texts=False: (bounded.append(texts), staged(df, tag, texts=texts))[1])
    assert langid.train_on_documents(df).languages == ["aa", "cc"]
    assert made == [pa.Table] and bounded == [True, True]


def test_other_languages_and_junk_are_rejected(spark):
    """Junk that bears a language's label neither loosens the floor nor passes it; short clean texts pass."""
    rows = [(text(lang, i, 20 + i % 60), lang) for i in range(120) for lang in ("aa", "cc")]
    noise = lambda i, n: " ".join("".join(random.Random(f"{i}/{k}").choices("bcdfghjklmnpqrstvwxz", k=7)) for k in range(n))
    rows += [(noise(i, 60), "aa") for i in range(6)]
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(df.withColumnRenamed("doc_id", "key"))
    clean = [(i, text(lang, 5000 + i, 3 + i)) for i in range(60) for lang in ("aa", "cc")]
    left_out = [(i, " ".join("".join(random.Random(i * 99 + k).choices(["wun", "dra", "ki", "pfo", "zey"], k=3)) for k in range(60))) for i in range(60)]
    junk = [(i, noise(i, 30 + i)) for i in range(30)]
    share = lambda some: sum(r.rejected for r in langid.predict(spark.createDataFrame(some, "doc_id long, text string"), model).collect()) / len(some)
    assert share(clean) == 0 and share(left_out) == 1 and share(junk) == 1


def test_n_grams_stay_within_a_text():
    a, _ = langid.gram_counts([b"abc", b"xyz"])
    b, _ = langid.gram_counts([b"abc"])
    c, n = langid.gram_counts([b"xyz"])
    assert (a == np.concatenate([b, c])).all() and n.tolist() == [3]


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    k = len(quality.LABELLERS)
    right = np.linspace(0.75, 0.95, k)
    says = rng.random((20000, k)) < right
    votes = np.where(says, good[:, None], ~good[:, None]).astype(np.int8)
    votes[rng.random((20000, k)) < 0.3] = quality.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    given = model.says[:, 1, quality.GOOD] / (1 - model.says[:, 1, quality.NONE])
    assert np.abs(given - right).max() < 0.03


def test_quality_of_plain_and_broken_texts(spark, docs, no_docs):
    r = random.Random(3)
    words = [w for lang in LANGUAGES for w in text(lang, 7, 200).split()]
    rows = []
    for i in range(300):
        own = [r.choice(words) for _ in range(r.randint(30, 200))]
        if i % 5 == 0:
            own = [w + r.choice(["***", "&&&", "%%%"]) for w in own] if i % 2 else [own[0]] * len(own)
            rows.append((i, " ".join(own), 0))
        else:
            rows.append((i, ". ".join(" ".join(own[k : k + 8]).capitalize() for k in range(0, len(own), 8)), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, keep int")
    model = quality.train(df)
    got = {x.doc_id: x for x in quality.score(df, model).collect()}
    right = sum(got[i].keep == bool(y) for i, _, y in rows)
    assert right >= 0.97 * len(rows)
    assert {x.quality for x in quality.score(docs, model).collect() if x.doc_id in (1, 2, 3)} == {0.0}
    assert quality.score(docs, model).count() == docs.count() and quality.score(no_docs).count() == 0


def test_the_scorers_sample_is_bounded_where_ids_are_missing_or_repeated(spark, monkeypatch):
    seen = []
    real = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, target: seen.append(len(rows)) or real(rows, target))
    for ids in ("CAST(NULL AS long)", "7L"):
        df = spark.range(600).selectExpr(f"{ids} AS doc_id", "concat_ws(' ', 'some plain words number', cast(id % 500 AS string)) AS text")
        quality.train(df, 50)
    assert all(20 <= n <= 50 for n in seen)


def test_votes_and_posterior_against_plain_python():
    texts = [b"Plain words, as usual. " * 5, b"AAAA BBBB!!! ??? ###", b"x x x x x x x x x x x x x x x x x x x x x x", b"", b"one|two|{three}|<four>"]
    _, stats = quality.described(texts)
    v = quality.votes(stats)
    for row, own in zip(v, stats, strict=True):
        for k, (name, bad, good) in enumerate(quality.LABELLERS):
            x = own[quality.STATS.index(name)]
            assert row[k] == (quality.BAD if x >= bad else quality.GOOD if x <= good else quality.NONE)
    rng = np.random.default_rng(1)
    says = rng.random((len(quality.LABELLERS), 2, 3)) + 0.1
    model = quality.Labels(0.7, says / says.sum(axis=2, keepdims=True))
    for row, p in zip(v, model.posterior(v), strict=True):
        good, bad = 0.7, 0.3
        for k, x in enumerate(row):
            good, bad = good * model.says[k, 1, x], bad * model.says[k, 0, x]
        assert abs(p - good / (good + bad)) < 1e-9


def test_the_language_sample_is_bounded_where_ids_or_texts_repeat(spark, monkeypatch):
    rows = [(1, prose(i % 2, 40), "en") for i in range(3000)] + [(None, prose(9, 30), "fr")] * 500 + [(i, prose(i, 20), f"l{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "key long, text string, lang string").repartition(4)
    seen = []
    kept = langid.vectors
    monkeypatch.setattr(langid, "vectors", lambda counts, idf: (seen.append(len(counts)), kept(counts, idf))[1])
    model = langid.train(df, fit_rows=50)
    assert max(seen) <= langid.FIT_MOST * 50 and len(model.languages) == 42
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    assert langid.train(df, fit_rows=50).languages == ["en", "fr"]


def test_language_vectors_and_rejection_against_plain_python(spark):
    """IDF, cosine and the floor of a text, from their definitions."""
    import math

    rows = [(i, prose(i, 30 + i % 50), "en" if i % 2 else "fr") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "key long, text string, lang string"), fit_rows=100)
    counts, letters = langid.gram_counts([t.encode() for _, t, _ in rows])
    has = [sum(1 for c in counts if c[b]) for b in range(langid.BUCKETS)]
    for b in (0, 17, 900, 8191):
        assert model.idf[b] == np.float32(math.log1p(len(rows) / (1 + has[b])))
    names, score, rejected = model.predict([t.encode() for _, t, _ in rows[:20]])
    for k in range(20):
        v = [math.log1p(n) * float(w) for n, w in zip(counts[k], model.idf, strict=True)]
        norm = math.sqrt(sum(x * x for x in v))
        cos = [sum(x * float(p) for x, p in zip(v, point, strict=True)) / norm for point in model.points]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert score[k] == pytest.approx(cos[best], abs=1e-5) and names[k] == model.languages[model.owner[best]]
        assert rejected[k] == (score[k] < model.floor[model.owner[best]][int(math.log2(letters[k]))])
