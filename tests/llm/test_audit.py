import re
from itertools import permutations

import duckdb
import pytest

from cladeframe.llm import audit
from cladeframe.llm.registry import ORACLES, QUERIES
from tests.llm.conftest import prose
from tests.test_queries import DATA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    fails = []
    for i, text, _ in docs:
        t = text or ""
        w = WORD.findall(t)
        caps = sum("A" <= c <= "Z" for c in t)
        first = [j for j, other, _ in docs if (other or "") == t and i is not None and j is not None and j < i]
        fails.append("".join(f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 3 * len(t), any(c in "#$%&*|" for c in t), bool(first)), strict=True) if bad))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in {p or "" for *_, p in docs}:
        own = [(i, f) for (i, _, p), f in zip(docs, fails, strict=True) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                failing = [x for _, x in own if f in x]
                steps.append((part, order, k, len(left), len(gone), len(failing) - len(gone), sum(x == f for x in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_against_brute_force(spark, docs, texts):
    own = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    more = [(500 + i, t, "en") for i, t in enumerate(["x " * 300, "A B C " * 100, "a | b", prose(9, 300), prose(9, 300), prose(9, 300), "50% " + prose(11, 210), ""])]
    extra = spark.createDataFrame([(*m, "s", 0, 0, "x", 0) for m in more], docs.schema)
    labels = [(6, 1, 0), (7, 1, 1), (7, 0, 0), (None, 1, 1), (12, 1, None), (503, 1, 0), (504, None, 1), (505, 1, 1), (99999, 1, 1)]
    label_rows = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = as_rows(audit.audit(docs.unionByName(extra), label_rows))
    assert got == brute(own + more, labels)
    assert {r[0] for r in got} == {"", "en", "fr"} and len(got) == 3 * 600


def test_no_documents_no_labels(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(no_docs, labels).count() == 0
    assert all(r[7:9] == (0, 0) for r in as_rows(audit.audit(docs, labels)))
    with pytest.raises(ValueError, match="lang"):
        audit.audit(docs.drop("lang"), labels)


def test_many_parts_and_one_with_most_rows(spark):
    n = 3000
    rows_ = [(i, f"w{i % 5} " * 250 if i % 3 else None, f"p{i}" if i % 2 else "hot") for i in range(n)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string").repartition(4)
    index = audit.bitmap_index(audit.judged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    counts = {(r.part, r.first): r.kept for r in audit.prefix_counts(index).collect()}
    assert sum(v for (_, s), v in counts.items() if s == 0) == n
    assert counts["hot", 0] == n // 2 and counts["hot", 1] == sum(1 for i in range(0, n, 2) if i % 3)
    assert counts["p3", 0] == 1 and counts["p3", 1] == 0


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_same_as_sql(spark):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = QUERIES["op11_filter_audit"](spark, str(DATA)).toPandas(), con.sql(ORACLES["op11_filter_audit"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
