"""Every query that has SQL returns the same rows as DuckDB on the smallest tables."""

import os
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from cladeframe.plans import catalog

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating, Decimal)):
        return round(float(v), 8) + 0.0
    return v


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows(spark, db, name):
    got = catalog.queries()[name](spark, str(DATA)).toPandas()
    want = db.sql(catalog.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_the_one_without_sql(spark):
    (r,) = catalog.queries()["mann_whitney_p"](spark, str(DATA)).collect()
    assert 0 <= r.p <= 1 and r.n_a > 0


def test_pairs_of_leaves_are_dealt_over_tasks(spark, monkeypatch, tmp_path):
    """One family of 300 leaves in one small file: its 44,850 pairs are made in several tasks."""
    from pyspark.sql import functions as F

    from cladeframe.plans import vote_queries

    monkeypatch.setattr("cladeframe.stage.TASK_ROWS", 1000)
    rows = spark.range(300).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), (F.col("id") * 7.5).alias("s_acctbal"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    _, _, d, _ = vote_queries._leaves(spark, str(tmp_path))
    per = [r["count"] for r in d.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(per) == 44_850 and len(per) > 30 and max(per) < 44_850 / 8


def test_medians_over_pairs_shuffle_no_pairs(spark, tmp_path):
    """Each gene's ratios are made where its leaf was dealt to; scores are those of pairs that are shuffled."""
    from pyspark.sql import functions as F

    from cladeframe.operators import prune as P
    from cladeframe.plans import vote_queries

    rows = spark.range(120).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3 % 2).alias("s_nationkey"), ((F.col("id") * 7919) % 1009 - 300.25).alias("s_acctbal"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    leaves, ratios, d, expected = vote_queries._leaves(spark, str(tmp_path))
    by_gene = ratios.groupBy("family", "gene").agg(F.median("ratio").alias("s"))
    assert by_gene._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, "leaves only"
    scores = lambda r: sorted((x.family, x.gene, round(x.s_raw, 12), round(x.s_norm, 12)) for x in P.relative_scores(leaves, r).collect())
    once = P.pair_ratios(leaves, d.select("family", "a", "b", "d"), expected)
    assert ratios.count() == 2 * once.count() and scores(ratios) == scores(once)
    assert sorted(P.absolute_scores(leaves, ratios).collect()) == sorted(P.absolute_scores(leaves, once).collect())


def test_pruning_takes_pairs_by_gene(spark, monkeypatch):
    from cladeframe.operators import prune as P
    from cladeframe.plans import vote_queries

    seen = []
    rank = P.relative_scores
    monkeypatch.setattr(P, "relative_scores", lambda leaves, ratios: seen.append(ratios.columns) or rank(leaves, ratios))
    vote_queries.prune_outliers(spark, str(DATA))
    assert "gene" in seen[0]
