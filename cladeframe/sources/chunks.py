"""Results of long tools, a chunk at a time: each chunk is written with a manifest of what it holds, and a set that isn't whole isn't read.

A chunk's rows are in data/chunk=N; manifest/chunk=N, written after them, has the keys it was to hold and those it holds, counted
and digested. A chunk that a stopped run left without a manifest counts as missing, one whose files changed since is refused.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "n_rows long, n_keys long, digest long, chunk int"


def _digest(columns: list[str]) -> list[Column]:
    """Number of rows and of keys, and a sum of row hashes that doesn't depend on their order but does on repeats."""
    return [F.count("*").alias("n_rows"), F.countDistinct("_key").alias("n_keys"), F.coalesce(F.sum(F.pmod(F.xxhash64(*columns), F.lit((1 << 31) - 1))), F.lit(0)).alias("digest")]


def write_chunk(results: DataFrame, folder: str, number: int, key: str) -> None:
    """Replace chunk number by results; the manifest is written last, of what the files then hold. An empty result is a chunk too."""
    path = f"{folder}/data/chunk={number}"
    results.write.mode("overwrite").parquet(path)
    spark = results.sparkSession
    held = spark.read.schema(results.schema).parquet(path)
    found = held.withColumn("_key", F.col(key)).agg(*_digest(held.columns))
    found.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/chunk={number}")


def _table(spark: SparkSession, path: str, schema: str | None) -> DataFrame | None:
    reader = spark.read.option("basePath", path)
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException:
        return None


def problems(spark: SparkSession, folder: str, expected: DataFrame, key: str, once: bool = True) -> DataFrame:
    """chunk, problem, n: what keeps the chunks under folder from being whole. expected: chunk, key (what each was to hold).

    missing: no manifest. changed: other rows than the manifest counted. not expected: a chunk that no key asks for. lost: expected keys without
    a row in their chunk (only with once: a tool may find nothing for a key). foreign: keys of another chunk or of none.
    repeated: keys with several rows (only with once). Every number is counted over all chunks in joins by chunk and key.
    """
    asked = expected.select(F.col("chunk").cast("int").alias("chunk"), F.col(key).alias("_key")).distinct()
    chunks = asked.select("chunk").distinct()
    marks = _table(spark, f"{folder}/manifest", MANIFEST)
    data = _table(spark, f"{folder}/data", None)
    out = spark.createDataFrame([], "chunk int, problem string, n long")
    say = lambda df, what, n: df.select(F.col("chunk").cast("int").alias("chunk"), F.lit(what).alias("problem"), n.cast("long").alias("n"))
    if marks is None:
        return out.unionByName(say(chunks, "missing", F.lit(1)))
    out = out.unionByName(say(chunks.join(marks, "chunk", "left_anti"), "missing", F.lit(1)))
    out = out.unionByName(say(marks.join(chunks, "chunk", "left_anti"), "not expected", F.col("n_rows")))
    if data is None:
        return out.unionByName(say(marks.where("n_rows > 0"), "changed", F.col("n_rows")))
    held = data.withColumn("_key", F.col(key))
    now = held.groupBy("chunk").agg(*_digest([c for c in data.columns if c != "chunk"])).select("chunk", *[F.col(c).alias(f"now_{c}") for c in ("n_rows", "n_keys", "digest")])
    same = marks.join(now, "chunk", "left")
    differ = F.lit(False)
    for c in ("n_rows", "n_keys", "digest"):
        differ = differ | (F.col(c) != F.coalesce(F.col(f"now_{c}"), F.lit(0)))
    out = out.unionByName(say(same.where(differ), "changed", F.abs(F.col("n_rows") - F.coalesce("now_n_rows", F.lit(0)))))
    keyed = held.groupBy("chunk", "_key").agg(F.count("*").alias("c"))
    counted = lambda df, what: say(df.groupBy("chunk").agg(F.count("*").alias("k")), what, F.col("k"))
    out = out.unionByName(counted(keyed.join(asked, ["chunk", "_key"], "left_anti"), "foreign"))
    if once:
        whole = asked.join(marks.select("chunk"), "chunk", "left_semi")
        out = out.unionByName(counted(whole.join(keyed, ["chunk", "_key"], "left_anti"), "lost")).unionByName(counted(keyed.where("c > 1"), "repeated"))
    return out


def read_chunks(spark: SparkSession, folder: str, expected: DataFrame, key: str, once: bool = True) -> DataFrame:
    """All chunks' rows with chunk. ValueError naming some of the problems if the set isn't whole."""
    if bad := problems(spark, folder, expected, key, once).orderBy("chunk", "problem").take(5):
        raise ValueError("; ".join(f"chunk {r.chunk}: {r.problem} ({r.n})" for r in bad))
    return spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")


def to_do(spark: SparkSession, folder: str, expected: DataFrame, key: str, once: bool = True) -> DataFrame:
    """The expected rows of chunks that must be run (again): those with any problem."""
    bad = problems(spark, folder, expected, key, once).select("chunk").distinct()
    return expected.join(bad, "chunk", "left_semi")
