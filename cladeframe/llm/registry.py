"""Queries of the corpus operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeframe.llm import audit, decontaminate, langid, mixing, neighbours, packing, pii, quality, quotes, secrets, sharding, simhash


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_langid": langid.op1_langid,
    "op2_quotes": quotes.op2_quotes,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op9_quality": quality.op9_quality,
    "op10_pii": pii.op10_pii,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_nndescent": neighbours.op6_nndescent,
    "op7_secrets": secrets.op7_secrets,
    "op8_hilbert": sharding.op8_hilbert,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_mixing": mixing.op12_mixing,
}

ORACLES: dict[str, str] = {"op11_filter_audit": audit.SQL, "op12_mixing": mixing.SQL}
