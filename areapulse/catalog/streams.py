"""The streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.catalog.registry import query
from areapulse.session import fresh_dir
from areapulse.sources.tables import SCHEMAS, table
from areapulse.streaming import streams


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return streams.file_stream(spark, sf, SCHEMAS["events"], "events.parquet")


@query("SELECT event_id, event_type, value, event_type = 'signup' AS was_stored FROM events")
def stream_insert_new(spark: SparkSession, sf: str) -> DataFrame:
    store = fresh_dir(spark, "stream-store")
    columns = ("event_id", "event_type", "value")
    # Sign-ups are stored already; errors are replayed.
    stored = table(spark, sf, "events").where("event_type = 'signup'").select(*columns)
    stored.write.parquet(f"{store}/batch=-1")
    stream = _events(spark, sf).select(*columns)
    replayed = stream.unionByName(_events(spark, sf).select(*columns).where("event_type = 'error'"))
    streams.stream_insert_new(replayed, "event_id", store, fresh_dir(spark, "stream-state")).awaitTermination()
    kept = spark.read.schema("event_id long, event_type string, value double, batch long").parquet(store)
    return kept.select(*columns, (F.col("batch") == -1).alias("was_stored"))


@query(
    """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS flagged
    FROM events GROUP BY 1
    """
)
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = fresh_dir(spark, "stream-days")
    flagged = _events(spark, sf).withColumn("flag", F.col("event_type") == "error")
    streams.stream_daily_counts(flagged, "ts", "flag", out, fresh_dir(spark, "stream-state")).awaitTermination()
    rows = spark.read.schema("day date, total long, flagged long, batch long").parquet(out)
    return streams.latest(rows, ["day"], ["total", "flagged"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    """
    WITH c AS (SELECT CAST(user_id % 10 AS INTEGER) AS area, event_type AS dimension, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2)
    SELECT area, dimension, n AS count, round(v, 6) AS avg_score, round(n / sum(n) OVER (PARTITION BY area)::DOUBLE * 100.0, 6) AS percentage FROM c
    """
)
def stream_dimension_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = fresh_dir(spark, "stream-cells")
    cells = _events(spark, sf).select((F.col("user_id") % 10).cast("int").alias("area"), F.col("event_type").alias("dimension"), "value")
    streams.stream_dimension_shares(cells, ["area", "dimension"], "value", out, fresh_dir(spark, "stream-state")).awaitTermination()
    rows = spark.read.schema("area int, dimension string, count long, total double, batch long").parquet(out)
    shares = streams.shares_of(rows, "area", "dimension")
    return shares.select("area", "dimension", "count", F.round("avg_score", 6).alias("avg_score"), F.round("percentage", 6).alias("percentage"))
