import corpus_pipeline
from cladeframe.llm.common import staged

from .conftest import prose


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    item = " ".join(f"item{i}word" for i in range(30))
    clean = [(i, prose(i, 150), "en", "s", 0) for i in range(1, 40)]
    rows = [*clean, (50, clean[0][1], "en", "s", 0), (51, clean[1][1] + " end", "en", "s", 0), (52, prose(52, 50) + " " + item, "en", "s", 0), (53, "mail bob@example.com " + prose(53, 60), "en", "s", 0), (54, None, None, None, None), (55, "123 456", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns
        if name == "personal_data":
            assert "<email>" in docs.where("doc_id = 53").first().text
    every = {r[0] for r in rows}
    assert kept[0] == every - {54, 55}
    assert kept[1] == kept[0] - {50, 51} and kept[2] == kept[1] - {52} and kept[3] == kept[2] == kept[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == kept[4]
