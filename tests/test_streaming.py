from corvane.streaming import incremental as S
from pyspark.sql import functions as F


def test_stream_merges_by_key_and_resumes(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    shape = "k int, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], shape).write.parquet(source)
    for rows in ([], [(2, "c"), (3, "d")]):
        if rows:
            spark.createDataFrame(rows, shape).write.mode("append").parquet(source)
        S.upsert_stream(S.read_arrivals(spark, source, shape), target, ["k"], mark).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(target).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_windows_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:00:30' + make_interval(0, 0, 0, 0, 0, id) as ts, 'x' as kind, id from range(5)").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, kind string, id long").parquet(source)
    q = S.tumbling(stream, "ts", "1 minute", ["kind"], "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 5


def test_state_between_batches(spark, tmp_path):
    source, mark = str(tmp_path / "s"), str(tmp_path / "m")
    seen = []
    for _ in range(2):
        spark.createDataFrame([("a",), ("a",), ("b",)], "k string").write.mode("append").parquet(source)
        out = S.running_counts(spark.readStream.schema("k string").parquet(source), "k")
        out.writeStream.foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {("a", 2), ("b", 1), ("a", 4), ("b", 2)} <= set(seen)


def test_pending(spark):
    assert [r.k for r in S.pending(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k").collect()] == [2]
