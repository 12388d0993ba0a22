from datetime import datetime, timedelta

from simweave.streaming.edits import debounced, real_edits, refresh_on_edits


def test_stream_agrees_with_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda ms: t + timedelta(milliseconds=ms)
    rows = [("a", at(0), 1), ("a", at(300), 1), ("a", at(2000), 1), ("b", at(100), 1), ("c", at(100), 0), (None, at(5), 1), ("z", at(60000), 1)]
    df = spark.createDataFrame(rows, "file_path string, ts timestamp, changes int")
    batch = {(r["file_path"], r["edits"]) for r in debounced(real_edits(df), "file_path").collect()}
    assert batch == {("a", 2), ("a", 1), ("b", 1), ("z", 1)}
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = real_edits(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    seen = set()
    q = refresh_on_edits(stream, lambda paths: seen.update(r["file_path"] for r in paths.collect()), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert seen == {"a", "b"}  # z's session is still open


def test_root_filter(spark):
    df = spark.createDataFrame([("/r/a", 1), ("/rest/a", 1)], "file_path string, changes int")
    assert [r["file_path"] for r in real_edits(df, "/r").collect()] == ["/r/a"]
