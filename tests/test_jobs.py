"""The jobs on copies of tables that grow, and on rows of every awkward kind."""

import json
import logging
import os
import statistics
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cladeframe.operators.rounds import Growth
from jobs import grow_families as G
from jobs import screen_sequences as Q
from jobs.common import settings
from tests.test_queries import DATA

ROOT = Path(__file__).resolve().parent.parent
SEQS = "id long, seq string, species string, family string"
SCREEN = Q.Screening(id="id", buckets=8, zscore_min_n=5)


def put(spark, rows, path, schema=SEQS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def screen(spark, where, c=SCREEN):
    return Q.run(spark, f"{where}/in", f"{where}/out", f"{where}/checkpoint", c)


def wanted(rows, c=SCREEN):
    """gene, family -> (length, stops, truncated, copy_of, score), in plain Python, without the composition."""
    genes = {}
    for i, seq, species, family in rows:
        if i is not None:
            genes[f"{species or 'unknown'}_{i}", family or "unknown"] = seq or ""
    by, first = defaultdict(list), {}
    for (g, f), s in genes.items():
        by[f].append(len(s))
        if s:
            first[f, s] = min(first.get((f, s), g), g)
    out = {}
    for (g, f), s in genes.items():
        stops = s.rstrip("*").count("*")
        short = len(s) < c.truncation * statistics.median(by[f])
        copy = first[f, s] if s and first[f, s] != g else None
        out[g, f] = (len(s), stops, short, copy, round(0.4 * (stops > 0) + 0.3 * short, 6))
    return out


def found(df):
    return {(r.gene, r.family): (r.length, r.internal_stops, r.truncated, r.copy_of, round(r.score, 6)) for r in df.collect()}


FIRST = [(1, "MKV*LL*", "oak", "f1"), (2, "MKVLLT", "oak", "f1"), (3, "MKVLLT", "elm", "f1"), (4, "M", "elm", "f1"), (5, None, "fig", "f2"), (6, "", "fig", "f2"), (7, "MMMM", None, None), (None, "MKV", "oak", "f1")]
SECOND = [(8, "MKVLLT", "ash", "f1"), (9, "MKVLLTAAAAAAAAAAAAAAAAAAA", "ash", "f3"), (2, "MKVLLTW", "oak", "f1"), (10, "A" * 40, "ash", "f1"), (11, "A" * 41, "ash", "f1"), (12, "A" * 42, "ash", "f1")]


def test_screening_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "cladeframe.screen_sequences")
    put(spark, FIRST, f"{tmp_path}/in")
    one = screen(spark, tmp_path)
    assert found(one) == wanted(FIRST)
    f2 = {r.f: r.t for r in one.where("family = 'f2'").select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).collect()}
    put(spark, SECOND, f"{tmp_path}/in")
    two = screen(spark, tmp_path)
    assert found(two) == wanted(FIRST + SECOND), "a gene that came again counts as it last came, medians are of whole families"
    said = [r.getMessage() for r in caplog.records]
    assert any("batch 0: read 8 sequences" in m and "1 without an id" in m for m in said) and any("batch 1: read 6 sequences" in m for m in said)
    bucket = {r.family: r.bucket for r in two.select("family", "bucket").distinct().collect()}
    if bucket["f2"] not in (bucket["f1"], bucket["f3"]):
        now = {r.f: r.t for r in two.where("family = 'f2'").select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).collect()}
        assert now == f2, "buckets without new sequences are left as they are"
    caplog.clear()
    assert found(screen(spark, tmp_path)) == wanted(FIRST + SECOND)
    assert any("no new batch since 1" in r.getMessage() for r in caplog.records)
    assert spark.read.parquet(f"{tmp_path}/out/refused").count() == 1


def test_screening_that_stopped_before_its_mark_reports_again(spark, tmp_path, monkeypatch):
    put(spark, FIRST, f"{tmp_path}/in")
    screen(spark, tmp_path)
    put(spark, SECOND, f"{tmp_path}/in")
    with monkeypatch.context() as m:
        m.setattr(Q, "report", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            screen(spark, tmp_path)
    assert found(screen(spark, tmp_path)) == wanted(FIRST + SECOND)


def test_screening_in_many_batches_is_the_same(spark, tmp_path):
    for rows in (FIRST, SECOND):
        for r in rows:
            put(spark, [r], f"{tmp_path}/in")
    got = screen(spark, tmp_path, Q.Screening(id="id", buckets=8, zscore_min_n=5, max_files_per_batch=1))
    assert found(got).keys() == wanted(FIRST + SECOND).keys()
    assert spark.read.parquet(f"{tmp_path}/out/screened").select("batch").distinct().count() > 5


def test_screening_without_files_or_rows(spark, tmp_path):
    put(spark, [], f"{tmp_path}/in")
    got = screen(spark, tmp_path)
    assert got is None or got.count() == 0
    put(spark, FIRST, f"{tmp_path}/in")
    assert found(screen(spark, tmp_path)) == wanted(FIRST)


def test_composition_of_a_family(spark, tmp_path):
    rows = [(i, "GA" * (20 + i % 3) + "T" * (i % 5), "oak", "f1") for i in range(30)] + [(99, "T" * 60, "oak", "f1")]
    put(spark, rows, f"{tmp_path}/in")
    odd = [r for r in screen(spark, tmp_path).collect() if r.zscore is not None]
    assert [r.gene for r in odd] == ["oak_99"] and odd[0].zscore < -3 and odd[0].score == 0.25


HITS = "gene string, profile string, family string, bits double"
GROW = G.Growing(min_score=50.0, min_seed_score=500.0)


def brute(rows, c=GROW):
    links, genes = defaultdict(set), set()
    placed = {}
    for g, p, f, b in rows:
        if g is None:
            continue
        genes.add(g)
        if b is not None and b >= c.min_score and p is not None:
            links[g].add(p)
        if b is not None and b >= c.min_seed_score and f is not None:
            placed[g] = (min(f, placed.get(g, (f,))[0]), 0)
    number, last = 0, set(placed)
    while last:
        number += 1
        reach = {}
        for g in last:
            for p in links[g]:
                reach[p] = min(reach.get(p, placed[g][0]), placed[g][0])
        new = {g: min(reach[p] for p in links[g] if p in reach) for g in genes - placed.keys() if any(p in reach for p in links[g])}
        placed |= {g: (f, number) for g, f in new.items()}
        last = set(new)
    return {g: (*placed[g], "placed") if g in placed else (None, None, "open" if links[g] else "unlinked") for g in genes}


def members(df):
    return {r.gene: (r.family, r["round"], r.status) for r in df.collect()}


def chain(n):
    rows = [("g0", "p0", "F1", 900.0), ("gz", f"p{n}", "F0", 600.0), (None, "p1", "F9", 999.0), ("x", "q", "F2", 60.0), ("y", "p1", "F2", 10.0), ("w", None, "F2", 70.0), ("v", "q", "F2", None), ("s", "s1", None, 900.0)]
    return rows + [(f"g{i}", f"p{j}", "F5", 100.0) for i in range(1, n) for j in (i - 1, i)] + [("g3", "p2", "F5", 100.0)]


def test_families_grow_until_nothing_joins(spark, tmp_path):
    rows = chain(14)
    put(spark, rows, f"{tmp_path}/hits", HITS)
    got = G.run(spark, f"{tmp_path}/hits", f"{tmp_path}/out", GROW)
    assert members(got) == brute(rows)
    assert max(r["round"] for r in got.where("status = 'placed'").collect()) >= 12, "as many rounds as the data need"


def test_growth_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rows = chain(8)
    put(spark, rows, f"{tmp_path}/hits", HITS)
    done = []
    whole = Growth._round

    def third_fails(self, mark):
        if mark["round"] == 2 and not done:
            done.append(2)
            # What a lost run leaves: genes of the round written, its mark not.
            self._put(spark.createDataFrame([("ghost", "F")], "gene string, family string"), "placed", 3)
            raise RuntimeError("stopped")
        return whole(self, mark)

    monkeypatch.setattr(Growth, "_round", third_fails)
    with pytest.raises(RuntimeError, match="stopped"):
        G.run(spark, f"{tmp_path}/hits", f"{tmp_path}/out", GROW)
    counted = []
    monkeypatch.setattr(Growth, "_round", lambda self, mark: (counted.append(mark["round"]), whole(self, mark))[1])
    assert members(G.run(spark, f"{tmp_path}/hits", f"{tmp_path}/out", GROW)) == brute(rows)
    assert counted[0] == 2, "rounds before the mark aren't run again"
    counted.clear()
    assert members(G.run(spark, f"{tmp_path}/hits", f"{tmp_path}/out", GROW)) == brute(rows) and not counted
    more = [("x", "p3", "F2", 80.0)]
    put(spark, more, f"{tmp_path}/hits", HITS)
    assert members(G.run(spark, f"{tmp_path}/hits", f"{tmp_path}/out", GROW)) == brute(rows + more) and counted[0] == 0


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_growth_over_random_hits_beyond_the_broadcast(spark, tmp_path, monkeypatch, share):
    import random

    from cladeframe.operators import rounds as R

    monkeypatch.setattr(R, "BROADCAST_ROWS", 3)
    r = random.Random(int(share) + 5)
    rows = [(f"g{r.randrange(60)}", "hot" if r.random() < 0.05 else f"p{r.randrange(50)}", f"F{r.randrange(4)}", r.choice([10.0, 60.0, 60.0, 60.0, 60.0, 990.0 if r.random() < 0.2 else 60.0])) for _ in range(110)]
    put(spark, rows, f"{tmp_path}/hits", HITS)
    hits = spark.read.parquet(f"{tmp_path}/hits")
    g = Growth(spark, f"{tmp_path}/rounds", share)
    mark = g.run(hits.where("bits >= 50"), hits.where("bits >= 500"))
    got = {x.gene: (x.family, x["round"], "placed") for x in g.placed(mark["round"]).collect()}
    assert got == {k: v for k, v in brute(rows).items() if v[2] == "placed"}


def test_no_hits(spark, tmp_path):
    put(spark, [], f"{tmp_path}/hits", HITS)
    assert G.run(spark, f"{tmp_path}/hits", f"{tmp_path}/out", GROW).count() == 0


def test_settings_and_command_line(tmp_path):
    assert settings(Q.Screening, None, "screen_sequences.json").family == "source"
    assert settings(G.Growing, None, "grow_families.json").max_rounds is None
    (tmp_path / "c.json").write_text(json.dumps({"bukets": 3}))
    with pytest.raises(ValueError, match="bukets"):
        settings(Q.Screening, str(tmp_path / "c.json"), "screen_sequences.json")
    for job in (Q, G):
        with pytest.raises(SystemExit):
            job.main(["--out", "x"])


def test_the_command_line_runs_a_job_and_logs(spark, tmp_path):
    rows = chain(3)
    put(spark, rows, f"{tmp_path}/hits", HITS)
    (tmp_path / "c.json").write_text(json.dumps({"min_score": 50.0, "min_seed_score": 500.0}))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell", "PYSPARK_GATEWAY_PORT": "", "SPARK_LOCAL_IP": "127.0.0.1"}
    env = {k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}
    ran = subprocess.run([sys.executable, "-m", "jobs.grow_families", "--hits", f"{tmp_path}/hits", "--out", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert f"cladeframe.grow_families read {len(rows)} hits" in ran.stderr and "in families after" in ran.stderr
    assert members(spark.read.schema(G.MEMBERS).parquet(f"{tmp_path}/out/members")) == brute(rows)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_the_text_table_dealt_over_two_runs(spark, tmp_path):
    """A copy of documents that grows gives what one run over the whole gives."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    c = settings(Q.Screening, None, "screen_sequences.json")
    half = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    docs.where(half).write.parquet(f"{tmp_path}/a/in")
    screen(spark, f"{tmp_path}/a", c)
    docs.where(~half).write.mode("append").parquet(f"{tmp_path}/a/in")
    docs.write.parquet(f"{tmp_path}/b/in")
    rounded = lambda df: sorted(repr(tuple(r)) for r in df.select([F.round(x, 9).alias(x) if t == "double" else F.col(x) for x, t in df.dtypes]).collect())
    a, b = screen(spark, f"{tmp_path}/a", c), screen(spark, f"{tmp_path}/b", c)
    assert a.columns == b.columns and rounded(a) == rounded(b)
