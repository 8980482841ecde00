"""Readers. Every table has a declared schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

# Document stores of the collectors (see FIXTURES.md).
POST = (
    "_id long, text string, author long, posting_ts double, "
    "comments array<struct<id:long, text:string, author:long, posting_ts:double, post_id:long>>"
)
TREND_DOCUMENT = (
    "interest_over_time struct<timeline_data: array<struct<timestamp: string, "
    "values: array<struct<query: string, extracted_value: double>>>>>, area string, keyword_set string"
)
FEATURES = "features array<struct<properties: map<string,string>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


# Text work is worth a task of its own from about this many stored bytes.
TASK_BYTES = 256 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of few, small files over the idle cores.

    A file is split at its row groups, so a small table of long texts is one task. A scan that already has a task per
    core is left alone, which is every scan at cluster size.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    stored = sum(row["length"] for row in spark.read.format("binaryFile").load(df.inputFiles()).select("length").collect())
    wanted = min(cores, stored // TASK_BYTES)
    return df.repartition(int(wanted)) if wanted > 1 else df


def spread_rows(df: DataFrame, key: str, parts: int = 32) -> DataFrame:
    """A training table in a fixed number of ordered partitions by the hash of its key.

    Learners draw random numbers per partition, so the model must not depend on the number of cores or files.
    """
    return df.repartition(parts, key).sortWithinPartitions(key)


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table with its declared schema, dealt over the cores if it is small."""
    return spread(table(spark, folder, name))


def scan_multi_file(spark: SparkSession, paths: str | Sequence[str], schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Every file of one or more globs in one scan, each row tagged with the base name of its file."""
    found = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.format(fmt).schema(schema).options(**options).load(found)
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def scan_selected_sources(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Rows of the requested sources. The literal list reaches the scan as a pushed or partition filter."""
    return df.where(F.col(column).isin(list(wanted)))


def scan_all_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of every collection, tagged with its name."""
    out = None
    for name, part in parts.items():
        tagged = part.select(F.lit(name).alias("collection"), "*")
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def lookup_by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows with one key; ``key`` may be a dotted path into a struct."""
    return df.where(F.col(key) == F.lit(value))


def scan_nested_series(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Trend documents to (ts, keyword, value). A document without a series gives no row."""
    points = docs.select(*keep, F.explode("interest_over_time.timeline_data").alias("point"))
    values = points.select(*keep, F.col("point.timestamp").alias("timestamp"), F.explode("point.values").alias("v"))
    return values.select(
        *keep,
        F.timestamp_seconds(F.col("timestamp").cast("long")).alias("ts"),
        F.col("v.query").alias("keyword"),
        F.col("v.extracted_value").alias("value"),
    )


def read_trend_documents(spark: SparkSession, path: str) -> DataFrame:
    """Trend documents stored as JSON lines."""
    return spark.read.schema(TREND_DOCUMENT).json(path)


def scan_feature_collection(spark_or_df: SparkSession | DataFrame, source: str) -> DataFrame:
    """GeoJSON features to one row per region with its property map.

    ``source`` is a path for a session, or the name of a JSON text column for a DataFrame.
    """
    if isinstance(spark_or_df, SparkSession):
        docs = spark_or_df.read.schema(FEATURES).option("multiLine", True).json(source)
    else:
        docs = spark_or_df.select(F.from_json(source, FEATURES).alias("j")).select("j.*")
    return docs.select(F.explode("features").alias("f")).select(F.col("f.properties").alias("properties"))


def epoch_filter(df: DataFrame, epoch: str, start: str, end: str) -> DataFrame:
    """Epoch seconds to a timestamp, kept when start <= ts < end."""
    ts = F.timestamp_seconds(F.col(epoch))
    return df.withColumn("posted_at", ts).where(
        (F.col("posted_at") >= F.lit(start).cast("timestamp")) & (F.col("posted_at") < F.lit(end).cast("timestamp"))
    )
