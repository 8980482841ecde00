"""Shares, trend averages and series over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.catalog.registry import ALL_STOP, AREAS, query, quoted, sql_clean, sql_has_word, sql_words
from areapulse.functions.text import words
from areapulse.operators import indicators as ind
from areapulse.operators import keywords as kw
from areapulse.operators import scoring, topics
from areapulse.params import MIN_CHARS, OTHER, STOP_WORDS, THRESHOLD
from areapulse.plans import texts as plan
from areapulse.plans import trends
from areapulse.sources.tables import table, text_table

DIMENSIONS = [*STOP_WORDS, OTHER]
# Class of a text: the language list with most hits among the cleaned words, OTHER for short texts and texts without hits.
_HITS = ", ".join(
    f"len(list_filter(w, lambda x: x IN ({quoted(ws)}))) AS n_{lang}" for lang, ws in sorted(STOP_WORDS.items())
)


def _sql_classed(tab: str, keys: str) -> str:
    return f"""
    c AS (SELECT {keys}, {sql_clean('text')} AS clean FROM {tab}),
    w AS (SELECT {keys}, clean, {sql_words('clean')} AS w FROM c),
    h AS (SELECT {keys}, clean, {_HITS} FROM w),
    k AS (SELECT {keys}, clean, CASE WHEN length(clean) < {MIN_CHARS} THEN 'OTHER'
            WHEN greatest(n_de, n_en, n_es, n_fr) = 0 THEN 'OTHER' ELSE CASE greatest(n_de, n_en, n_es, n_fr) WHEN n_de THEN 'de'
            WHEN n_en THEN 'en' WHEN n_es THEN 'es' ELSE 'fr' END END AS dimension FROM h)
    """


_GRID = "d(dimension) AS (VALUES " + ", ".join(f"('{d}')" for d in DIMENSIONS) + ")"
SHARES_SQL = f"""
    WITH {_sql_classed('documents', 'source')}, {_GRID}, a AS (SELECT DISTINCT source FROM documents),
         n AS (SELECT source, dimension, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT source AS area, dimension, coalesce(n, 0) AS count,
           CAST(sum(coalesce(n, 0)) OVER (PARTITION BY source) AS BIGINT) AS total_posts,
           round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY source)::DOUBLE * 100.0, 6) AS percentage
    FROM a CROSS JOIN d LEFT JOIN n USING (source, dimension)
"""


@query(SHARES_SQL)
def dimension_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = plan.area_shares(text_table(spark, sf, "documents"), "source", "text", STOP_WORDS)
    return shares.select(F.col("source").alias("area"), "dimension", "count", "total_posts", F.round("percentage", 6).alias("percentage"))


@query(
    f"""
    WITH {_sql_classed('conversations', 'conv_id, turn, role')}, {_GRID}, a AS (SELECT DISTINCT role FROM conversations),
         s AS (SELECT role, dimension, length(clean) % 3 - 1 AS s FROM k WHERE length(clean) >= {MIN_CHARS}),
         n AS (SELECT role, dimension, count(*) AS n, sum(s) AS s FROM s GROUP BY 1, 2),
         t AS (SELECT role, count(*) FILTER (turn = 0) AS videos, count(*) FILTER (turn > 0) AS comments FROM k GROUP BY 1)
    SELECT role AS area, dimension, round(coalesce(s::DOUBLE / n, 0), 6) AS avg_sentiment, coalesce(n, 0) AS mentions_count,
           round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY role)::DOUBLE * 100.0, 6) AS percentage_of_total,
           videos AS videos_analyzed, comments AS comments_analyzed
    FROM a CROSS JOIN d LEFT JOIN n USING (role, dimension) JOIN t USING (role)
    """
)
def conditional_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    turns = plan.classed_by_words(text_table(spark, sf, "conversations"), "text", STOP_WORDS)
    # Short texts are dropped from every share; the sentiment classes -1, 0, 1 follow the text length.
    kept = F.when(F.length("clean") >= MIN_CHARS, F.col("dimension"))
    scored = turns.withColumn("kept", kept).withColumn("sentiment", (F.length("clean") % 3 - 1).cast("double"))
    scored = scored.withColumn("is_parent", F.col("turn") == 0).withColumn("is_raw", F.col("turn") > 0)
    rows = ind.conditional_sentiment(scored, "role", "kept", "sentiment", DIMENSIONS, "is_parent", "is_raw")
    return rows.select(
        F.col("role").alias("area"),
        "dimension",
        F.round("avg_sentiment", 6).alias("avg_sentiment"),
        "mentions_count",
        F.round("percentage_of_total", 6).alias("percentage_of_total"),
        "videos_analyzed",
        "comments_analyzed",
    )


@query(
    f"""
    WITH {_sql_classed('conversations', 'role')}, {_GRID}, a AS (SELECT DISTINCT role FROM conversations),
         n AS (SELECT role, dimension, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT role AS area, dimension, coalesce(n, 0) AS count FROM a CROSS JOIN d LEFT JOIN n USING (role, dimension)
    """
)
def comment_counts_only(spark: SparkSession, sf: str) -> DataFrame:
    turns = plan.classed_by_words(text_table(spark, sf, "conversations"), "text", STOP_WORDS)
    return ind.comment_counts_only(turns, "role", "dimension", DIMENSIONS).withColumnRenamed("role", "area")


@query(
    f"""
    WITH {_sql_classed('documents', 'source')}
    SELECT coalesce(source, '*') AS area, coalesce(dimension, '*') AS dimension, count(*) AS count
    FROM k GROUP BY ROLLUP (source, dimension)
    """
)
def overall_totals(spark: SparkSession, sf: str) -> DataFrame:
    docs = plan.classed_by_words(text_table(spark, sf, "documents"), "text", STOP_WORDS)
    totals = ind.overall_totals(docs, "source", "dimension")
    return totals.select(F.coalesce("source", F.lit("*")).alias("area"), F.coalesce("dimension", F.lit("*")).alias("dimension"), "count")


def _series(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trend values: area = ten user buckets, period = week, two overlapping collections by parity of k."""
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        (F.col("user_id") % 10).cast("int").alias("area"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("period"),
        F.concat(F.lit("set"), (k % 2).cast("string")).alias("collection"),
        F.col("event_type").alias("keyword"),
        "value",
    )


_SERIES = """
    e AS (SELECT CAST(user_id % 10 AS INTEGER) AS area, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period,
                 'set' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 2) AS collection, event_type AS keyword, value
          FROM events)
"""
# Half-even rounding on the binary double, as the Spark side does.
_R2 = "round_even({0} * 100.0, 0) / 100.0"
TREND_GROUPS = {"use": ("click", "view"), "trade": ("purchase", "signup"), "fault": ("error",), "none": ("missing",)}
TREND_WORDS = [w for ws in TREND_GROUPS.values() for w in ws]


@query(f"WITH {_SERIES} SELECT area, period, keyword, {_R2.format('avg(value)')} AS mean_value FROM e GROUP BY 1, 2, 3")
def keyword_period_mean(spark: SparkSession, sf: str) -> DataFrame:
    return ind.keyword_period_mean(_series(spark, sf), ["area", "period", "keyword"], "value")


_MEANS = f"""
    {_SERIES}, w(keyword) AS (VALUES {', '.join(f"('{w}')" for w in TREND_WORDS)}),
    m AS (SELECT area, period, collection, keyword, {_R2.format('avg(value)')} AS v FROM e GROUP BY ALL),
    b AS (SELECT area, period, keyword, {_R2.format('avg(v)')} AS v FROM m GROUP BY ALL),
    g AS (SELECT area, period, keyword, coalesce(v, 0) AS mean_value
          FROM (SELECT DISTINCT area, period FROM e) CROSS JOIN w LEFT JOIN b USING (area, period, keyword))
"""


@query(f"WITH {_MEANS} SELECT * FROM g")
def mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    return ind.mean_of_means(_series(spark, sf), ["area", "period"], "collection", "keyword", "value", TREND_WORDS)


@query(
    f"""
    WITH {_MEANS}, d(dimension, keyword) AS (VALUES {', '.join(f"('{d}', '{w}')" for d, ws in TREND_GROUPS.items() for w in ws)})
    SELECT area, period, dimension, coalesce({_R2.format('avg(mean_value) FILTER (mean_value > 0)')}, 0) AS mean_value
    FROM g JOIN d USING (keyword) GROUP BY 1, 2, 3
    """
)
def nonzero_dimension_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = ind.mean_of_means(_series(spark, sf), ["area", "period"], "collection", "keyword", "value", TREND_WORDS)
    return ind.nonzero_dimension_mean(means, ["area", "period"], "keyword", "mean_value", TREND_GROUPS)


@query(
    f"""
    WITH y AS (SELECT CAST(user_id % 10 AS VARCHAR) AS area, year(ts) AS year, CAST(user_id % 3 AS VARCHAR) AS collection,
                      event_type AS keyword, value FROM events),
         w(keyword) AS (VALUES {', '.join(f"('{w}')" for w in TREND_WORDS)}),
         m AS (SELECT area, year, collection, keyword, {_R2.format('avg(value)')} AS v FROM y WHERE year = 2024 GROUP BY ALL),
         b AS (SELECT area, year, keyword, {_R2.format('avg(v)')} AS v FROM m GROUP BY ALL),
         g AS (SELECT area, year, keyword, coalesce(v, 0) AS mean_value
               FROM (SELECT DISTINCT area, year FROM y WHERE year = 2024) CROSS JOIN w LEFT JOIN b USING (area, year, keyword)),
         d(dimension, keyword) AS (VALUES {', '.join(f"('{d}', '{w}')" for d, ws in TREND_GROUPS.items() for w in ws)})
    SELECT area, CAST(year AS INTEGER) AS year, dimension, coalesce({_R2.format('avg(mean_value) FILTER (mean_value > 0)')}, 0) AS mean_value
    FROM g JOIN d USING (keyword) GROUP BY 1, 2, 3
    """
)
def dimension_interest(spark: SparkSession, sf: str) -> DataFrame:
    # One trend document per event, nested as the collector stores it.
    events = table(spark, sf, "events")
    point = F.struct(
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
        F.array(F.struct(F.col("event_type").alias("query"), F.col("value").alias("extracted_value"))).alias("values"),
    )
    docs = events.select(
        F.struct(F.array(point).alias("timeline_data")).alias("interest_over_time"),
        (F.col("user_id") % 10).cast("string").alias("area"),
        (F.col("user_id") % 3).cast("string").alias("keyword_set"),
    )
    return trends.dimension_interest(docs, [2024], TREND_GROUPS)


# Keyword blocks with the blanks of a typed list; each becomes one phrase and is encoded as the texts are.
BLOCKS = {lang: "\n  " + "\n  ".join(ws) + " " for lang, ws in STOP_WORDS.items()}
VOCABULARY = ALL_STOP
_SCORES = ", ".join(f"len(list_filter(w, lambda x: x IN ({quoted(ws)}))) / (norm * sqrt({len(ws)}::DOUBLE)) AS s_{lang}" for lang, ws in STOP_WORDS.items())
_BEST = "greatest(" + ", ".join(f"s_{lang}" for lang in STOP_WORDS) + ")"


def _sql_encoded(tab: str, keys: str) -> str:
    """Class of a text by the cosine of its keyword counts with the counts of each block's phrase."""
    return f"""
    c AS (SELECT {keys}, text, {sql_clean('text')} AS clean FROM {tab}),
    w AS (SELECT {keys}, text, clean, {sql_words('clean')} AS w FROM c),
    m AS (SELECT *, sqrt(list_sum(list_transform([{quoted(VOCABULARY)}], lambda k: len(list_filter(w, lambda x: x = k)) ** 2))) AS norm FROM w),
    v AS (SELECT *, {_SCORES} FROM m),
    k AS (SELECT {keys}, text, clean, CASE WHEN length(clean) < {MIN_CHARS} OR norm = 0 OR {_BEST} < {THRESHOLD} THEN 'OTHER'
            {" ".join(f"WHEN s_{lang} = {_BEST} THEN '{lang}'" for lang in STOP_WORDS)} END AS dimension FROM v)
    """


_ENCODER = {"encoder": scoring.term_counter(VOCABULARY)}
_NAMED = ", ".join(f"({quoted([a])})" for a in AREAS)
_MENTIONS = " UNION ALL ".join(f"SELECT {quoted([a])} AS area, dimension FROM k WHERE {sql_has_word('text', a)}" for a in AREAS)


@query(
    f"""
    WITH {_sql_encoded('documents', 'doc_id')}, {_GRID}, a(area) AS (VALUES {_NAMED}), t AS ({_MENTIONS}),
         n AS (SELECT area, dimension, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT area, dimension, coalesce(n, 0) AS count, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY area) AS BIGINT) AS total_posts,
           round(CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY area) = 0 THEN 0
                 ELSE coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY area)::DOUBLE * 100.0 END, 6) AS percentage
    FROM a CROSS JOIN d LEFT JOIN n USING (area, dimension)
    """
)
def post_shares(spark: SparkSession, sf: str) -> DataFrame:
    labels, prototypes = scoring.phrase_prototypes(spark, BLOCKS, **_ENCODER)
    posts = text_table(spark, sf, "documents").select("doc_id", "text")
    shares = plan.post_shares(posts, "doc_id", "text", AREAS, prototypes, labels, **_ENCODER)
    return shares.select("area", "dimension", "count", "total_posts", F.round("percentage", 6).alias("percentage"))


@query(
    f"""
    WITH {_sql_encoded('conversations', 'conv_id, turn, role')}, {_GRID}, a AS (SELECT DISTINCT role FROM conversations),
         l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS s FROM labels),
         r AS (SELECT k.*, s FROM k JOIN l ON conv_id = doc_id),
         n AS (SELECT role, dimension, count(*) AS n, sum(s) AS s FROM r WHERE length(clean) >= {MIN_CHARS} GROUP BY 1, 2),
         t AS (SELECT role, count(*) FILTER (turn = 0) AS videos, count(*) FILTER (turn > 0) AS comments FROM r GROUP BY 1)
    SELECT role AS area, dimension, round(coalesce(s::DOUBLE / n, 0), 6) AS avg_sentiment, coalesce(n, 0) AS mentions_count,
           round(CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY role) = 0 THEN 0
                 ELSE coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY role)::DOUBLE * 100.0 END, 6) AS percentage_of_total,
           videos AS videos_analyzed, comments AS comments_analyzed
    FROM a CROSS JOIN d LEFT JOIN n USING (role, dimension) JOIN t USING (role)
    """
)
def comment_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    labels, prototypes = scoring.phrase_prototypes(spark, BLOCKS, **_ENCODER)
    rated = table(spark, sf, "labels").select(
        F.col("doc_id").alias("conv_id"), F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0).alias("sentiment")
    )
    turns = text_table(spark, sf, "conversations").join(rated, "conv_id")
    turns = turns.withColumns({"is_parent": F.col("turn") == 0, "is_raw": F.col("turn") > 0})
    rows = plan.comment_sentiment(turns, "role", "conv_id", "text", "sentiment", prototypes, "is_parent", "is_raw", labels, **_ENCODER)
    return rows.select(
        F.col("role").alias("area"),
        "dimension",
        F.round("avg_sentiment", 6).alias("avg_sentiment"),
        "mentions_count",
        F.round("percentage_of_total", 6).alias("percentage_of_total"),
        "videos_analyzed",
        "comments_analyzed",
    )


@query(
    """
    WITH u AS (SELECT lang, 'documents' AS s FROM documents
               UNION ALL SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1), 'pages' FROM pages)
    SELECT lang, count(*) FILTER (s = 'documents') AS n_documents, count(*) FILTER (s = 'pages') AS n_pages, count(*) AS n_total
    FROM u GROUP BY 1
    """
)
def source_period_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", F.lit("documents").alias("s"))
    pages = table(spark, sf, "pages").select(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.lit("pages").alias("s"))
    return ind.source_period_counts(docs.unionByName(pages), ["lang"], "s", ["documents", "pages"])


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as topic probabilities: the squared entries, scaled to sum 1."""
    first = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    squares = table(spark, sf, "embeddings").select("vec_id", "label", first.alias("sq"))
    total = squares.withColumn("total", F.aggregate("sq", F.lit(0.0), lambda a, x: a + x))
    return total.select("vec_id", "label", F.transform("sq", lambda x: x / F.col("total")).alias("p"))


_WEIGHTS = """
    q AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS sq FROM embeddings),
    p AS (SELECT vec_id, label, list_transform(sq, lambda x: x / list_sum(sq)) AS p FROM q)
"""


@query(
    f"""
    WITH {_WEIGHTS}, x AS (SELECT label, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS topic FROM p)
    SELECT label, CAST(topic AS INTEGER) AS topic, round(avg(CASE WHEN v >= 0.01 THEN v ELSE 0 END), 6) AS share FROM x GROUP BY 1, 2
    """
)
def topic_shares(spark: SparkSession, sf: str) -> DataFrame:
    return ind.topic_shares(_weights(spark, sf), ["label"], "p").select("label", "topic", F.round("share", 6).alias("share"))


@query(
    """
    WITH d AS (SELECT CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS topic FROM embeddings)
    SELECT topic, count(*) AS count, round(count(*) / (SELECT count(*) FROM d)::DOUBLE * 100.0, 6) AS percentage FROM d GROUP BY 1
    """
)
def dominant_topic(spark: SparkSession, sf: str) -> DataFrame:
    from areapulse.functions.vectors import argmax_index

    best = table(spark, sf, "embeddings").select(argmax_index(F.col("embedding")).alias("topic"))
    return ind.dominant_topic(best, "topic").select("topic", "count", F.round("percentage", 6).alias("percentage"))


@query(
    """
    SELECT lang AS topic, doc_id, n_chars,
           CASE WHEN length(text) > 150 THEN text[1:150] || '...' ELSE text END AS preview
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1
    """
)
def topic_exemplar(spark: SparkSession, sf: str) -> DataFrame:
    return ind.topic_exemplar(table(spark, sf, "documents"), "lang", "n_chars", "doc_id", "text").withColumnRenamed("lang", "topic")


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("ts", "event_type", "value", (F.col("event_type") == "error").alias("flag"))


@query(
    """
    WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS flagged FROM events GROUP BY 1),
         g AS (SELECT CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM c)
    SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(total, 0) AS total, coalesce(flagged, 0) AS flagged,
           coalesce(total, 0) - coalesce(flagged, 0) AS unflagged
    FROM g LEFT JOIN c USING (day)
    """
)
def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ind.daily_counts(_daily(spark, sf), "ts", "flag").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    """
    SELECT count(*) FILTER (event_type = 'error') AS flagged, count(*) AS total,
           round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM events
    """
)
def flag_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return ind.flag_ratio(_daily(spark, sf), "flag").withColumn("ratio", F.round("ratio", 6))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_SHORT = ("urgent", "high", "medium", "unspecified", "low")


def _rounded_wide(df: DataFrame, places: int = 4) -> DataFrame:
    named = df.withColumnsRenamed(dict(zip(PRIORITIES, _SHORT)))
    return named.select(F.date_format("period", "yyyy-MM").alias("period"), *[F.round(c, places).alias(c) for c in _SHORT])


@query(
    "SELECT strftime(o_orderdate, '%Y-%m') AS period, "
    + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderpriority = '{p}'), 4) AS {s}" for p, s in zip(PRIORITIES, _SHORT))
    + " FROM orders GROUP BY 1"
)
def period_mean_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = ind.period_mean_wide(table(spark, sf, "orders"), "o_orderdate", "month", "o_orderpriority", "o_totalprice", PRIORITIES)
    return _rounded_wide(wide)


@query(
    """
    WITH m AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS period, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
    SELECT series, period, round(CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END, 4) AS rolling_mean FROM m
    WINDOW w AS (PARTITION BY series ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
    """
)
def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    monthly = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
        .agg(F.avg("o_totalprice").alias("v"))
    )
    return ind.rolling_mean(monthly, "series", "period", "v").select("series", "period", F.round("rolling_mean", 4).alias("rolling_mean"))


@query(
    """
    SELECT series, round(v, 6) AS mean_value, CAST(rank() OVER (ORDER BY v DESC) AS INTEGER) AS rank
    FROM (SELECT event_type AS series, avg(value) AS v FROM events GROUP BY 1)
    """
)
def series_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranked = ind.series_ranking(table(spark, sf, "events").withColumnRenamed("event_type", "series"), "series", "value")
    return ranked.select("series", F.round("mean_value", 6).alias("mean_value"), "rank")


NUMERICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS series_a, '{b}' AS series_b, round(corr({a}, {b}), 6) AS pearson FROM lineitem" for a in NUMERICS for b in NUMERICS
    )
)
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    matrix = ind.correlation_matrix(table(spark, sf, "lineitem"), NUMERICS)
    return matrix.select("series_a", "series_b", F.round("pearson", 6).alias("pearson"))


@query("SELECT n_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    # Counted by key before the names are joined.
    counts = ind.value_counts(table(spark, sf, "customer"), "c_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return counts.join(nations, "c_nationkey").select("n_name", "count").orderBy(F.desc("count"), "n_name")


@query(
    f"""
    WITH t AS (SELECT unnest({sql_words('text')}) AS word FROM documents),
         k(dimension, word) AS (VALUES {', '.join(f"('{d}', '{w}')" for d, ws in STOP_WORDS.items() for w in ws)}),
         c AS (SELECT dimension, count(*) AS word_count FROM t JOIN k USING (word) GROUP BY 1)
    SELECT dimension, word_count, CAST(row_number() OVER (ORDER BY word_count DESC, dimension) AS INTEGER) AS position FROM c
    """
)
def sorted_report(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [(d, w) for d, ws in STOP_WORDS.items() for w in ws]
    hits = kw.find_phrases(text_table(spark, sf, "documents"), "text", kw.phrase_list(spark, pairs), [])
    return ind.sorted_report(hits.groupBy("dimension").agg(F.sum("hits").alias("word_count")), "word_count", "dimension")


TOP_TERMS = {0: ("the", "and", "of", "that", "zzzz"), 1: ("les", "des", "dans"), 2: ("und", "das", "nicht")}
_PAIRS = [(t, a, b) for t, ts in TOP_TERMS.items() for i, a in enumerate(ts) for b in ts[i + 1 :]]


@query(
    f"""
    WITH w AS (SELECT doc_id, list_distinct({sql_words('text')}) AS w FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM w),
         p(topic, a, b) AS (VALUES {', '.join(f"({t}, '{a}', '{b}')" for t, a, b in _PAIRS)}),
         c AS (SELECT topic, a, b, count(*) FILTER (list_contains(w, a)) AS na,
                      count(*) FILTER (list_contains(w, a) AND list_contains(w, b)) AS nab FROM p, w GROUP BY 1, 2, 3)
    SELECT topic, round(avg(ln((nab / n + 1e-12) / (na / n))), 6) AS u_mass FROM c, n WHERE na > 0 GROUP BY 1
    """
)
def topic_coherence(spark: SparkSession, sf: str) -> DataFrame:
    scores = topics.topic_coherence(text_table(spark, sf, "documents"), words(F.col("text")), TOP_TERMS)
    return scores.select("topic", F.round("u_mass", 6).alias("u_mass"))
