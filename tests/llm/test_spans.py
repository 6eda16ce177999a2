import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import pii, secrets
from cladeframe.llm import spans as S

ASSIGN = re.compile(secrets.ASSIGN)


def secret_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def strings(seed, alphabet, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_secrets_against_brute_force(spark, texts):
    more = strings(1, [*'ab0 ="_:\U0001f600é', "token", "Secret", "AKIA", "API_key", "passwd", "XYZ9", "deadbeef", "0123456789abcdef"], 800, 14)
    more += ["token=secret: abcdefghij", "password: short password=longenough1", 'apikey":"abc/+=.-_12', "AKIA" * 9, "f" * 31 + "g" + "e" * 32, "x token = zzzzzzzz" * 300]
    rows = [(i, t) for i, t in texts] + list(enumerate(more, 10000))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = secrets.scan(df).select("doc_id", F.sha2(S.said(F.col("base")), 256).alias("h"), S.said(F.col("spans")).alias("s"), S.said(F.col("base")).alias("b")).collect()
    want = sorted((str(i), hashlib.sha256(said(secret_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.h) for r in got) == want
    assert all(not r.b or set(r.b.split(",")) <= set(r.s.split(",")) for r in got)


def test_models_tell_random_strings_from_identifiers(spark):
    ratios, threshold = secrets.train(secrets.labelled_sample(spark))
    good = ["get_user_account_settings_handler", "maximumLikelihoodEstimatorFactory", "organization-administration-guide", "thtiontionanonstingblehathere", "INTERNATIONAL_STANDARD_NUMBER"]
    bad = ["Zk3x9QpL0vT7bRm2WcYh8NfJ", "9f86d081884c7d659a2feaa0c55a", "QWxhZGRpbjpvcGVuIHNlc2FtZQx9", "7HF2KQ9ZL4MXW8RT3VBN6YCJ"]
    df = spark.createDataFrame([(x,) for x in good + bad], "text string")
    found = [r[0] > threshold for r in df.select(secrets.mean_ratio(F.col("text"), ratios)).collect()]
    assert found == [False] * len(good) + [True] * len(bad)
    out = secrets.scan(spark.createDataFrame([(1, "key is Zk3x9QpL0vT7bRm2WcYh8NfJ ok")], "doc_id long, text string")).collect()
    assert [(x.kind, x.s, x.e) for x in out[0].spans] == [("model", 7, 31)]


def test_pii_against_brute_force(spark, texts):
    more = strings(2, list("a1@.- +0925(%)xé\U0001f600"), 1200, 120) + strings(3, list("0123 4567-89"), 300, 60)
    more += ["a@b.c_d@e.f g@h", "1.2.3.4.5.6.7.8 300.1.1.1 00012.0.0.1", "+1 (206) 555-0100 4111 1111 1111 1111", "a" * 20000 + "@" + "b" * 20000, "a@b" + ".c" * 9000, "1" + " 2" * 9000]
    rows = [(i, t) for i, t in texts] + list(enumerate(more, 10000))
    model = pii.train(pii.labelled_sample(spark))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, s int")
    got = pii.scan(df, model).select("doc_id", S.said(F.col("pii_base")).alias("b"), S.said(F.col("pii_spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.b) for r in got) == sorted((str(i), said(pii_spans(t or ""))) for i, t in rows)
    assert all(not r.b or set(r.b.split(",")) <= set(r.s.split(",")) for r in got)


def test_trees_and_threshold(spark):
    model = pii.train(pii.labelled_sample(spark))
    assert 0.5 <= model.threshold < 1 and model.trees
    fresh = pii.labelled_sample(spark, 1500).withColumn("text", F.concat(F.lit("Well. "), "text"))
    n = pii.scan(fresh, model).select("label", F.exists("pii_spans", lambda x: x["kind"] == "model").alias("hit")).groupBy("label", "hit").count().collect()
    by = {(r["label"], r["hit"]): r["count"] for r in n}
    assert by[(1, True)] > 0.85 * (by[(1, True)] + by.get((1, False), 0)) and by.get((0, True), 0) <= 0.02 * by[(0, False)]


def test_redaction(spark, docs):
    df = spark.createDataFrame([(1, "write to a.b@example.com or +1 (206) 555-0100 now", 10), (2, None, 0), (3, "clean é text", 3)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "write to <email> or <phone> now" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean é text"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0 and secrets.scan(docs.limit(0)).count() == 0


def overlap(a, b):
    return a[0] < b[1] and b[0] < a[1]


def test_overlaps_and_runs_against_brute_force(spark):
    r = random.Random(5)
    spans = lambda n: sorted((s, s + r.randint(1, 9)) for s in (r.randrange(60) for _ in range(r.randint(0, n))))
    rows = [(i, spans(9), spans(6)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, c array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    typed = F.transform("c", lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("k"), x["e"].alias("e"), F.lit("x").alias("kind")))
    out = df.select("i", S.without_overlap(F.col("c"), F.col("b")).alias("free"), S.runs(typed).alias("runs")).collect()
    for got, (_, cs, bs) in zip(sorted(out), rows, strict=True):
        assert sorted((x.s, x.e) for x in got.free) == [c for c in cs if not any(overlap(c, b) for b in bs)]
        want = []
        for s, e in cs:
            if want and s < want[-1][1]:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        assert [[x.s, x.e] for x in got.runs] == want


def seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def test_texts_dense_in_matches_take_time_in_proportion(spark):
    one = "a.b@example.com 312-555-0188 password=abcdefgh12 "
    model = pii.train(pii.labelled_sample(spark))

    def took(n):
        df = spark.createDataFrame([(1, one * n, 1)], "doc_id long, text string, n_chars long")
        return seconds(pii.redact(df, model)), seconds(secrets.scan(df))

    took(500)
    few, many = took(6000), took(24000)
    assert all(b < 8 * a + 2 for a, b in zip(few, many, strict=True)), (few, many)


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "to a.b@example.com", "mine", "his")], "doc_id long, text string, text_ string, Base_ string")
    row = pii.redact(df).collect()[0]
    assert (row.text, row.text_, row.Base_) == ("to <email>", "mine", "his")
    with pytest.raises(ValueError, match="pii_base"):
        pii.scan(df.withColumn("pii_base", F.lit(1)))
