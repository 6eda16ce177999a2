"""Chunks that are whole are read, and each way in which they aren't is named."""

import pytest

from cladeframe.sources import chunks as K

EXPECTED = [(n, f"g{n}{i}") for n in range(4) for i in range(5)]


@pytest.fixture
def expected(spark):
    return spark.createDataFrame(EXPECTED, "chunk int, gene string")


def rows(spark, n, keys):
    return spark.createDataFrame([(k, 0.5 * i) for i, k in enumerate(keys)], "gene string, score double")


def write(spark, folder, skip=()):
    for n in range(4):
        if n not in skip:
            K.write_chunk(rows(spark, n, [g for c, g in EXPECTED if c == n]), folder, n, "gene")


def said(spark, folder, expected, **k):
    return {(r.chunk, r.problem, r.n) for r in K.problems(spark, folder, expected, "gene", **k).collect()}


def test_whole_chunks_are_read_and_written_again(spark, tmp_path, expected):
    folder = str(tmp_path)
    assert said(spark, folder, expected) == {(n, "missing", 1) for n in range(4)}
    write(spark, folder)
    write(spark, folder, skip=(0, 1))
    assert said(spark, folder, expected) == set()
    assert {(r.chunk, r.gene) for r in K.read_chunks(spark, folder, expected, "gene").collect()} == set(EXPECTED)
    assert K.to_do(spark, folder, expected, "gene").count() == 0


def test_each_kind_of_damage(spark, tmp_path, expected):
    folder = str(tmp_path)
    write(spark, folder, skip=(3,))
    K.write_chunk(rows(spark, 0, ["g00", "g01", "g02", "g03"]), folder, 0, "gene")  # the tool lost a gene
    K.write_chunk(rows(spark, 1, ["g10", "g11", "g12", "g13", "g14", "g14", "g20"]), folder, 1, "gene")  # one twice, one of another chunk
    rows(spark, 2, ["g20", "g21"]).write.mode("overwrite").parquet(f"{folder}/data/chunk=2")  # cut after its manifest
    K.write_chunk(rows(spark, 9, ["g90"]), folder, 9, "gene")
    got = said(spark, folder, expected)
    assert got == {(3, "missing", 1), (0, "lost", 1), (1, "repeated", 1), (1, "foreign", 1), (2, "changed", 3), (2, "lost", 3), (9, "not expected", 1), (9, "foreign", 1)}
    assert {(c, p) for c, p, _ in said(spark, folder, expected, once=False)} == {(c, p) for c, p, _ in got if p not in ("lost", "repeated")}
    with pytest.raises(ValueError, match="chunk 0: lost"):
        K.read_chunks(spark, folder, expected, "gene")
    assert {r.chunk for r in K.to_do(spark, folder, expected, "gene").collect()} == {0, 1, 2, 3}


def test_rows_put_in_for_others_are_seen(spark, tmp_path, expected):
    folder = str(tmp_path)
    write(spark, folder)
    rows(spark, 2, [f"g2{i}" for i in (1, 0, 2, 3, 4)]).write.mode("overwrite").parquet(f"{folder}/data/chunk=2")
    assert said(spark, folder, expected) == {(2, "changed", 0)}


def test_chunks_that_found_nothing(spark, tmp_path, expected):
    folder = str(tmp_path)
    for n in range(4):
        K.write_chunk(rows(spark, n, []), folder, n, "gene")
    assert said(spark, folder, expected, once=False) == set()
    assert K.read_chunks(spark, folder, expected, "gene", once=False).count() == 0
    assert {p for _, p, _ in said(spark, folder, expected)} == {"lost"}
