import zlib
from collections import Counter

from cladeframe.llm import sharding as S


def test_curve_visits_every_cell_by_unit_steps(spark):
    for dims, bits in ((2, 3), (3, 2), (3, 3), (4, 2)):
        place = {r.cell: r.curve for r in S.hilbert_table(spark, dims, bits).collect()}
        assert sorted(place.values()) == list(range(1 << dims * bits))
        path = sorted(place, key=place.get)
        mask = (1 << bits) - 1
        for a, b in zip(path, path[1:], strict=False):
            assert sum(abs((a >> bits * d & mask) - (b >> bits * d & mask)) for d in range(dims)) == 1


def test_shards(docs, texts):
    rows = S.hilbert_shards(docs, 7).collect()
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in rows) == Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(a > b for a, b in zip(order, order[1:], strict=False)) <= 2 * 6, "but for rows exchanged at the six cuts, the order is the curve's"


def test_manifest_and_empty(docs, no_docs):
    shards = S.hilbert_shards(docs, 5)
    m = S.shard_manifest(shards).collect()
    assert sum(r["rows"] for r in m) == docs.count() and all(r.min_curve <= r.max_curve for r in m)
    assert S.hilbert_shards(no_docs).count() == 0


def test_equal_texts_are_one_run(spark):
    """Copies in several sources and languages follow each other; only a full shard parts them."""
    rows = [(i, f"text {i % 40}" if i % 3 else "everywhere", [None, "en", "de"][i % 7 % 3], f"s{i % 11}") for i in range(600)]
    got = sorted(S.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), 6).collect(), key=lambda r: (r.shard, r.slot))
    texts = {i: t for i, t, _, _ in rows}
    runs = 1 + sum(texts[a.doc_id] != texts[b.doc_id] for a, b in zip(got, got[1:], strict=False))
    assert runs == len(set(texts.values()))
    assert {r.doc_id: (r.lang, r.source) for r in got} == {i: (lang, source) for i, _, lang, source in rows}


def test_the_manifest_prunes_shards(spark):
    rows = [(i, "x" * (10 + i * 7 % 900), ["en", "de", "fr", "es"][i % 4], f"s{i % 10:02}") for i in range(4000)]
    m = S.shard_manifest(S.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 40)).collect()
    for name, value in (("lang", "fr"), ("source", "s03"), ("size", 500)):
        assert sum(r[f"min_{name}"] <= value <= r[f"max_{name}"] for r in m) <= 30


def test_no_cut_parts_a_group_that_a_shard_can_hold(spark):
    import random

    for seed, shards in ((1, 8), (2, 40), (3, 5)):
        r = random.Random(seed)
        rows = []
        for g in range(60):
            rows += [(f"copy {g} " + "y" * r.randrange(300), r.choice(["en", "de"]), f"s{r.randrange(5)}")] * r.choice([2, 3, 8, 20])
        rows += [(f"own {i} " + "z" * r.randrange(300), r.choice(["en", "de", None]), f"s{r.randrange(5)}") for i in range(1500)]
        r.shuffle(rows)
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
        got = S.hilbert_shards(df, shards).collect()
        where, counts = {}, Counter(x.shard for x in got)
        for x in got:
            where.setdefault(rows[x.doc_id][0], set()).add(x.shard)
        assert all(len(v) == 1 for v in where.values())
        assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
        for s, n in counts.items():
            assert sorted(x.slot for x in got if x.shard == s) == list(range(n))


def test_order_and_cuts_against_plain_python(spark):
    """The curve index of each row's cell by the same table, rows by curve and hash, runs of equal number."""
    rows = [(i, f"t{i} " + "w" * (i * 37 % 500), ["en", "fr"][i % 2], f"s{i % 3}") for i in range(300)]
    got = S.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 7).collect()
    curve = {x.cell: x.curve for x in S.hilbert_table(spark, 3, S.BITS).collect()}
    assert all(x.curve == curve[x.cell] for x in got)
    order = sorted(got, key=lambda x: (x.curve, x.text_crc32))
    assert [x.doc_id for x in sorted(got, key=lambda x: (x.shard, x.slot))] == [x.doc_id for x in order]
    assert [x.shard for x in order] == [k * 7 // 300 for k in range(300)]
