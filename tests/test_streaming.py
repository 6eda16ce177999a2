from cladeframe.streaming.placement import assigned, place_arriving


def test_batches_place_what_fits_and_keep_it(spark, tmp_path):
    schema = "gene string, family string, bits double, evalue double"
    first = spark.createDataFrame([("a", "F1", 200.0, 1e-9), ("a", "F2", 100.0, 1e-9), ("b", "F1", 200.0, 1e-9), ("b", "F2", 199.0, 1e-9)], schema)
    second = spark.createDataFrame([("a", "F9", 900.0, 1e-9), ("b", "F3", 500.0, 1e-9), ("c", "F1", 90.0, 1.0)], schema)
    for df in (first, second):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = place_arriving(stream, f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination(120)
        assert q.exception() is None
    assert {r.gene: r.family for r in assigned(spark, f"{tmp_path}/out").collect()} == {"a": "F1", "b": "F3"}
