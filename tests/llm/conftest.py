import pytest

WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice([",", "."]) if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts of every awkward kind: null, empty, blank, short, very long, odd characters, copies, repeated rows."""
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Two words"), (6, prose(1, 60000)), (7, prose(2, 80)), (8, prose(2, 80)), (9, prose(2, 80).upper()), (10, "12 34 !!"), (11, "é́ ﬁ \U0001f600 \x1c İstanbul ǰ"), (12, prose(3, 400)), (12, prose(3, 400)), (13, prose(3, 400).replace("the", "teh", 1)), (None, prose(5, 30)), (14, "a" * 5000)]
    return rows + [(100 + i, prose(100 + i, 20 + i)) for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with columns whose names clash with those used inside."""
    rows = [(i, t, ["en", "fr", None][k % 3], f"s{k % 4}", len(t or ""), k, "x", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, a int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
