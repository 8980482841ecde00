import datetime as dt

from pyspark.sql import functions as F

from areapulse.session import fresh_dir
from areapulse.streaming import streams

SCHEMA = "id long, ts timestamp, area string, kind string, score double"


def _files(spark):
    """Three files with a replayed record and a second day."""
    path = fresh_dir(spark, "stream-in")
    day = dt.datetime(2024, 1, 1, 12)
    batches = [
        [(1, day, "a", "x", 1.0), (2, day, "a", "y", 3.0)],
        [(2, day, "a", "y", 3.0), (3, day + dt.timedelta(days=1), "b", "x", 5.0)],
        [(3, day + dt.timedelta(days=1), "b", "x", 5.0), (4, day, "a", "x", 2.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def test_insert_new_over_several_batches(spark):
    store = fresh_dir(spark, "store")
    spark.createDataFrame([(1, "x")], "id long, kind string").write.parquet(f"{store}/batch=-1")
    stream = streams.file_stream(spark, _files(spark), SCHEMA, files_per_batch=1).select("id", "kind")
    streams.stream_insert_new(stream, "id", store, fresh_dir(spark, "state")).awaitTermination()
    kept = spark.read.schema("id long, kind string, batch long").parquet(store)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 4]
    assert kept.where("batch >= 0").count() == 3


def test_daily_counts_equal_batch(spark):
    out = fresh_dir(spark, "days")
    path = _files(spark)
    stream = streams.file_stream(spark, path, SCHEMA, files_per_batch=1).withColumn("f", F.col("kind") == "x")
    streams.stream_daily_counts(stream, "ts", "f", out, fresh_dir(spark, "state"), "3 days").awaitTermination()
    rows = spark.read.schema("day date, total long, flagged long, batch long").parquet(out)
    got = {str(r["day"]): (r["total"], r["flagged"]) for r in streams.latest(rows, ["day"], ["total", "flagged"]).collect()}
    assert got == {"2024-01-01": (4, 2), "2024-01-02": (2, 2)}


def test_shares_equal_batch(spark):
    out = fresh_dir(spark, "cells")
    stream = streams.file_stream(spark, _files(spark), SCHEMA, files_per_batch=1)
    streams.stream_dimension_shares(stream, ["area", "kind"], "score", out, fresh_dir(spark, "state")).awaitTermination()
    rows = spark.read.schema("area string, kind string, count long, total double, batch long").parquet(out)
    got = {(r["area"], r["kind"]): (r["count"], r["avg_score"], r["percentage"]) for r in streams.shares_of(rows, "area", "kind").collect()}
    assert got == {("a", "x"): (2, 1.5, 50.0), ("a", "y"): (2, 3.0, 50.0), ("b", "x"): (2, 5.0, 100.0)}


def test_late_records_and_text_keys_are_kept(spark):
    store, path = fresh_dir(spark, "store"), fresh_dir(spark, "late")
    spark.createDataFrame([("k0", "x")], "id string, kind string").write.parquet(f"{store}/batch=-1")
    for rows in ([("k1", "x"), ("k1", "x")], [("k2", "x")], [("k3", "late"), ("k0", "x"), (None, "n")]):
        spark.createDataFrame(rows, "id string, kind string").coalesce(1).write.mode("append").parquet(path)
    stream = streams.file_stream(spark, path, "id string, kind string", files_per_batch=1)
    streams.stream_insert_new(stream, "id", store, fresh_dir(spark, "state")).awaitTermination()
    kept = spark.read.schema("id string, batch long").parquet(store)
    assert sorted(str(r["id"]) for r in kept.collect()) == ["None", "k0", "k1", "k2", "k3"]


def test_ten_batches_read_the_store_once(spark):
    store, path, state = fresh_dir(spark, "store"), fresh_dir(spark, "ten"), fresh_dir(spark, "state")
    spark.createDataFrame([(k, "old") for k in range(0, 40, 4)], "id long, kind string").write.parquet(f"{store}/batch=-1")
    for i in range(10):
        # Each file repeats half of the one before and a stored key.
        rows = [(k, f"f{i}") for k in range(i * 4 - 2, i * 4 + 4) if k >= 0] + [(0, "again")]
        spark.createDataFrame(rows, "id long, kind string").coalesce(1).write.mode("append").parquet(path)
    stream = streams.file_stream(spark, path, "id long, kind string", files_per_batch=1)
    query = streams.stream_insert_new(stream, "id", store, state)
    query.awaitTermination()
    kept = spark.read.schema("id long, kind string, batch long").parquet(store)
    assert sorted(r["id"] for r in kept.collect()) == list(range(40))
    read = [[s["numInputRows"] for s in p["sources"] if "batch=-1" in s["description"]] for p in query.recentProgress]
    assert read[0] == [10] and all(sum(n) == 0 for n in read[1:]) and len(read) >= 10
    # A replay finds every key in the state.
    spark.createDataFrame([(k, "replay") for k in range(40)], "id long, kind string").write.mode("append").parquet(path)
    streams.stream_insert_new(stream, "id", store, state).awaitTermination()
    assert kept.count() == 40 and kept.where("kind = 'replay'").count() == 0
