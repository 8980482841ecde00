"""The ingest and count operators as Structured Streaming jobs over file sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from areapulse.functions.numeric import share


def file_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermarked timestamp; zone-less timestamps cannot carry a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _start(df: DataFrame, mode: str, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_insert_new(stream: DataFrame, key: str, store: str, checkpoint: str) -> StreamingQuery:
    """Append records with an unseen key to ``store``, however late they come; the key may have any type.

    Seen keys are keyed state in RocksDB, which lies on disk and grows with the distinct keys only. Rows stored before are in
    ``batch=-1`` of the store: their keys stream in beside the first batch and seed the state, which is the only time that the
    store is read. That batch alone cannot tell which of two equal keys came from the store, so it is checked against those
    keys once; every later batch is settled by the state. Each batch owns the folder ``batch=<id>``, which it overwrites, and
    the state is kept by batch too: one that is replayed after a failure does not add its rows twice.
    """
    spark = stream.sparkSession
    kind = stream.schema[key].dataType.simpleString()
    first = f"{store}/batch=-1"
    rows = stream.select(F.struct("*").alias("row"), F.col(key).alias("_key"))
    seeded = _has_files(spark, first)
    if seeded:
        stored = spark.readStream.schema(f"`{key}` {kind}").parquet(first)
        nothing = F.lit(None).cast(rows.schema["row"].dataType).alias("row")
        rows = rows.unionByName(stored.select(nothing, F.col(key).alias("_key")))
    unseen = rows.dropDuplicates(["_key"])

    def write(found: DataFrame, batch: int) -> None:
        if batch == 0 and seeded:
            # The state may have kept the stored one of two equal keys or the new one.
            known = found.sparkSession.read.schema(f"`{key}` {kind}").parquet(first).select(F.col(key).alias("_seen"))
            found = found.join(known, F.col("_key").eqNullSafe(F.col("_seen")), "left_anti")
        found.where(F.col("row").isNotNull()).select("row.*").write.mode("overwrite").parquet(f"{store}/batch={batch}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        return _start(unseen, "append", checkpoint, write)
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _has_files(spark: SparkSession, folder: str) -> bool:
    """Whether a folder of rows exists, on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def stream_daily_counts(stream: DataFrame, ts: str, flag: str, out: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Total and flagged records per event-time day; the state of a day is dropped once the watermark has passed it."""
    days = (
        event_time(stream, ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("flagged"))
        .select(F.to_date("w.start").alias("day"), "total", "flagged")
    )

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return _start(days, "update", checkpoint, write)


def latest(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """State of each key after its last update."""
    last = F.max(F.struct("batch", *values)).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{v}").alias(v) for v in values])


def stream_dimension_shares(stream: DataFrame, keys: Sequence[str], score: str, out: str, checkpoint: str) -> StreamingQuery:
    """Running count and score sum per (area, dimension). The state is one row per cell, whatever the stream length."""
    cells = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum(score).alias("total"))

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return _start(cells, "update", checkpoint, write)


def shares_of(cells: DataFrame, area: str, dimension: str) -> DataFrame:
    """Share and mean score per cell from the latest state."""
    now = latest(cells, [area, dimension], ["count", "total"])
    whole = now.groupBy(area).agg(F.sum("count").alias("_all"))
    return now.join(whole, area).select(
        area, dimension, "count", (F.col("total") / F.col("count")).alias("avg_score"), share(F.col("count"), F.col("_all")).alias("percentage")
    )
