"""Scans, sinks and ingest hygiene over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.catalog.registry import query, quoted
from areapulse.functions.text import SPACE
from areapulse.operators import ingest
from areapulse.session import fresh_dir
from areapulse.sources import sinks, tables
from areapulse.sources.buckets import BucketStore
from areapulse.sources.tables import table


@query(
    """
    SELECT 'nation.parquet' AS source_file, n_nationkey AS key, n_name AS name FROM nation
    UNION ALL SELECT 'region.parquet', r_regionkey, r_name FROM region
    """
)
def scan_multi_file(spark: SparkSession, sf: str) -> DataFrame:
    schema = "n_nationkey int, n_name string, r_regionkey int, r_name string"
    rows = tables.scan_multi_file(spark, [f"{sf}/nation.parquet", f"{sf}/region.parquet"], schema)
    return rows.select("source_file", F.coalesce("n_nationkey", "r_regionkey").alias("key"), F.coalesce("n_name", "r_name").alias("name"))


@query(
    """
    SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, event_type AS keyword, value
    FROM events WHERE event_type <> 'error'
    UNION ALL
    SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S'), event_type || '_k',
           CAST(json_extract_string(props, '$.k') AS DOUBLE)
    FROM events WHERE event_type <> 'error'
    """
)
def scan_nested_series(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    point = F.struct(
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
        F.array(
            F.struct(F.col("event_type").alias("query"), F.col("value").alias("extracted_value")),
            F.struct(F.concat("event_type", F.lit("_k")).alias("query"), F.col("k").alias("extracted_value")),
        ).alias("values"),
    )
    # Error events stand for documents without a series.
    series = F.when(F.col("event_type") != "error", F.struct(F.array(point).alias("timeline_data")))
    raw = events.select("event_id", F.to_json(F.struct(series.alias("interest_over_time"))).alias("doc"))
    docs = raw.select("event_id", F.from_json("doc", tables.TREND_DOCUMENT).alias("d")).select("event_id", "d.*")
    flat = tables.scan_nested_series(docs, ["event_id"])
    return flat.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT n_name AS state_name, CAST(n_nationkey AS VARCHAR) AS value_key FROM nation")
def scan_feature_collection(spark: SparkSession, sf: str) -> DataFrame:
    properties = F.create_map(F.lit("state_name"), "n_name", F.lit("value_key"), F.col("n_nationkey").cast("string"))
    doc = F.to_json(F.struct(F.array(F.struct(properties.alias("properties"))).alias("features")))
    flat = tables.scan_feature_collection(table(spark, sf, "nation").select(doc.alias("doc")), "doc")
    return flat.select(F.col("properties")["state_name"].alias("state_name"), F.col("properties")["value_key"].alias("value_key"))


@query("SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src3', 'src99')")
def scan_selected_sources(spark: SparkSession, sf: str) -> DataFrame:
    return tables.scan_selected_sources(table(spark, sf, "documents"), "source", ["src1", "src3", "src99"]).select("doc_id", "source", "lang")


@query(
    """
    SELECT collection, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
      SELECT 'documents' AS collection, text FROM documents
      UNION ALL SELECT 'benchmark', text FROM benchmark
      UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY collection
    """
)
def scan_all_sources(spark: SparkSession, sf: str) -> DataFrame:
    parts = {n: table(spark, sf, n).select("text") for n in ("documents", "benchmark", "conversations")}
    return tables.scan_all_sources(parts).groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


@query("SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE conv_id = 7")
def lookup_by_key(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "conversations").select(F.struct(F.col("conv_id").alias("videoId")).alias("_id"), "turn", "role", "text")
    found = tables.lookup_by_key(nested, "_id.videoId", 7)
    return found.select(F.col("_id.videoId").alias("conv_id"), "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query(
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, count(*) AS n_orders,
           round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1, 2
    """
)
def sink_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))
    path = fresh_dir(spark, "orders-by-year")
    sinks.sink_partitioned(orders, path, ["year"])
    back = spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double, year int").parquet(path)
    return back.groupBy("year", F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    """
    SELECT doc_id, lang, n_chars FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1
    """
)
def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # A digest as the key keeps long texts out of the sort and the exchange.
    keyed = docs.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_key"))
    return ingest.dedupe_keep_last(keyed, "text_key", "doc_id").drop("text_key")


@query(
    """
    SELECT doc_id, lang, n_chars FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
    """
)
def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    keyed = docs.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_key"))
    return ingest.dedupe_keep_first(keyed, "text_key", "doc_id").drop("text_key")


INSERT_STORED = ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7")


@query(
    f"""
    WITH incoming AS (
      SELECT doc_id, source, lang, 1 AS batch FROM documents
      UNION ALL SELECT doc_id, source, lang, 2 AS batch FROM documents WHERE lang = 'fr')
    SELECT doc_id, source, max(batch) AS batch FROM incoming
    WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source IN ({quoted(INSERT_STORED)}))
    GROUP BY doc_id, source
    """
)
def insert_new_only(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    stored = docs.where(F.col("source").isin(list(INSERT_STORED)))
    # French documents arrive twice in the batch.
    incoming = docs.withColumn("batch", F.lit(1)).unionByName(docs.where("lang = 'fr'").withColumn("batch", F.lit(2)))
    return ingest.insert_new_only(stored, incoming, "doc_id", "batch").select("doc_id", "source", "batch")


@query(
    """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    """
)
def update_set_by_key(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    patch = customer.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 100).alias("c_acctbal"),
        F.when(F.col("c_acctbal") < 0, "REVIEW").alias("c_mktsegment"),
    ).where("c_acctbal is not null or c_mktsegment is not null")
    return ingest.update_set_by_key(customer, patch, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query(
    """
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_nationkey = 3 AND c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment
    FROM customer WHERE c_nationkey <> 5
    UNION ALL
    SELECT CAST(c_custkey AS BIGINT), c_acctbal, CASE WHEN c_acctbal < 0 THEN 'REVIEW' END FROM customer WHERE c_nationkey = 5
    """
)
def upsert_buckets(spark: SparkSession, sf: str) -> DataFrame:
    # Customers of one nation are patched, those of another are new and come with what the patch says of them.
    customer = table(spark, sf, "customer").withColumn("c_custkey", F.col("c_custkey").cast("long"))
    schema = "c_custkey long, c_acctbal double, c_mktsegment string"
    store = BucketStore(spark, fresh_dir(spark, "customer-buckets"), "c_custkey", schema, 32)
    store.create(customer.where("c_nationkey <> 5"))
    review = F.when(F.col("c_acctbal") < 0, "REVIEW").alias("c_mktsegment")
    balance = F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")).alias("c_acctbal")
    store.upsert(customer.where("c_nationkey IN (3, 5)").select("c_custkey", balance, review))
    return store.rows()


@query(
    """
    SELECT doc_id, source, source IN ('src1', 'src2') AS was_stored FROM documents
    """
)
def insert_new_buckets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    stored = F.col("source").isin("src1", "src2")
    store = BucketStore(spark, fresh_dir(spark, "document-buckets"), "doc_id", "doc_id long, source string, was_stored boolean", 32)
    store.create(docs.where(stored).withColumn("was_stored", F.lit(True)))
    # Everything arrives, and some of it twice.
    again = docs.where("doc_id % 3 = 0").withColumn("n", F.lit(2))
    incoming = docs.withColumn("n", F.lit(1)).unionByName(again).withColumn("was_stored", F.lit(False))
    store.insert_new(incoming, "n")
    return store.rows()


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS _id, p_partkey, p_name FROM part")
def assign_row_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.assign_row_ids(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")


@query("SELECT page_id, sha256(url) AS _id FROM pages")
def content_hash_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", ingest.content_hash_id(F.col("url")).alias("_id"))


@query(
    """
    WITH r AS (SELECT event_type, date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS hi
               FROM events GROUP BY 1),
         c AS (SELECT event_type, hi, unnest(generate_series(lo, hi - INTERVAL 1 SECOND, INTERVAL 7 DAY)) AS s FROM r)
    SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY s) - 1 AS INTEGER) AS chunk_no,
           strftime(s, '%Y-%m-%d') AS chunk_start, strftime(least(s + INTERVAL 7 DAY, hi), '%Y-%m-%d') AS chunk_end
    FROM c
    """
)
def date_chunks(spark: SparkSession, sf: str) -> DataFrame:
    ranges = table(spark, sf, "events").groupBy("event_type").agg(
        F.date_trunc("day", F.min("ts")).alias("lo"),
        (F.date_trunc("day", F.max("ts")) + F.expr("interval 1 day")).alias("hi"),
    )
    chunks = ingest.date_chunks(ranges, "lo", "hi", 7)
    return chunks.select(
        "event_type",
        "chunk_no",
        F.date_format("chunk_start", "yyyy-MM-dd").alias("chunk_start"),
        F.date_format("chunk_end", "yyyy-MM-dd").alias("chunk_end"),
    )


@query(
    """
    SELECT CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / (10 * 86400000000.0)) AS INTEGER) AS chunk_no,
           count(*) AS n_events, round(sum(value), 2) AS total_value
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-29' GROUP BY 1
    """
)
def chunk_range_join(spark: SparkSession, sf: str) -> DataFrame:
    tagged = ingest.chunk_range_join(table(spark, sf, "events"), "ts", "2024-01-01", "2024-01-29", 10)
    return tagged.groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("total_value"))


@query(
    """
    WITH p AS (SELECT conv_id, max(text) FILTER (turn = 0) AS title, max(text) FILTER (turn = 1) AS description
               FROM conversations GROUP BY 1)
    SELECT conv_id, true AS is_parent, md5(coalesce(title, '') || '. ' || coalesce(description, '')) AS text_hash FROM p
    UNION ALL SELECT conv_id, false, md5(text) FROM conversations WHERE turn >= 2
    """
)
def flatten_thread(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    heads = turns.where("turn < 2")
    parents = (
        turns.select("conv_id")
        .distinct()
        .join(heads.where("turn = 0").select("conv_id", F.col("text").alias("title")), "conv_id", "left")
        .join(heads.where("turn = 1").select("conv_id", F.col("text").alias("description")), "conv_id", "left")
    )
    flat = ingest.flatten_thread(parents, turns.where("turn >= 2"), "conv_id", "title", "description", "text")
    return flat.select("conv_id", "is_parent", F.md5("text").alias("text_hash"))


@query(
    """
    SELECT conv_id, turn, role FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3
    """
)
def cap_children(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.cap_children(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query(
    """
    SELECT page_id, CASE WHEN url LIKE 'https%' THEN url ELSE replace(url, 'http://', 'https://') END AS effective_url
    FROM pages WHERE html NOT LIKE '%lang="en"%'
    """
)
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    # English pages have content; plain http addresses have a decoded form.
    pages = table(spark, sf, "pages").select(
        "page_id",
        "url",
        F.when(F.contains("html", F.lit('lang="en"')), ingest.extract_main_text(F.col("html"))).otherwise("").alias("content"),
        F.when(F.startswith("url", F.lit("https")), "").otherwise(F.replace("url", F.lit("http://"), F.lit("https://"))).alias("decoded_url"),
    )
    return ingest.pending_work(pages, "content", ["decoded_url", "url"]).select("page_id", "effective_url")


def _sql_main_text(col: str) -> str:
    s = rf"regexp_replace(coalesce({col}, ''), '(?s)<!--.*?-->', '', 'g')"
    for tag in ingest.DROPPED_BLOCKS:
        s = rf"regexp_replace({s}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    return s


def _sql_tidy(col: str) -> str:
    s = rf"regexp_replace({col}, '(?i)</?(?:{ingest.LINE_TAGS})(?:\s[^>]*)?/?>', chr(10), 'g')"
    s = rf"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for entity, char in ingest.ENTITIES:
        literal = "'" + char.replace("'", "''") + "'"
        s = f"replace({s}, '{entity}', {literal})"
    s = rf"regexp_replace({s}, '[ \t]+', ' ', 'g')"
    s = rf"regexp_replace({s}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({s}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


@query(
    rf"""
    WITH a AS (SELECT page_id, {_sql_main_text('html')} AS body FROM pages),
         b AS (SELECT page_id, body, regexp_extract(body, '(?is)<article(?:\s[^>]*)?>(.*)</article\s*>', 1) AS art FROM a),
         c AS (SELECT page_id, {_sql_tidy("CASE WHEN art <> '' THEN art ELSE body END")} AS content FROM b)
    SELECT page_id, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_hash FROM c
    """
)
def extract_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", ingest.extract_main_text(F.col("html")).alias("content"))
    return pages.select("page_id", F.length("content").alias("n_chars"), F.md5("content").alias("content_hash"))
