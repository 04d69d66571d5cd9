from tessella.streaming.ingest import arrivals, ingest, watch


def test_files_reach_the_store_once(spark, tmp_path):
    folder, path, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    spark.createDataFrame([("a",), ("b",)], "content string").write.parquet(folder)
    rows = watch(spark, folder, "content string")
    ingest(rows, path, mark).awaitTermination()
    spark.createDataFrame([("b",), ("c",)], "content string").write.mode("append").parquet(folder)
    ingest(watch(spark, folder, "content string"), path, mark).awaitTermination()
    assert spark.read.parquet(path).count() == 3


def test_arrivals(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'aa' AS content UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'aa'").write.parquet(folder)
    query = arrivals(watch(spark, folder, "ts timestamp, content string"), "ts").writeStream.format("memory").queryName("arrived").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    row = spark.table("arrived").first()
    assert (row["blobs"], row["bytes"], row["distinct_blobs"]) == (2, 4, 1)
