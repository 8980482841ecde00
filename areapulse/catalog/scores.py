"""Prototype classes and sentiment over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.catalog.registry import query, sql_words
from areapulse.functions import vectors
from areapulse.operators import scoring
from areapulse.operators.sizing import local_table
from areapulse.params import CLASS_SCORES, OTHER, STOP_WORDS, THRESHOLD
from areapulse.sources.tables import table, text_table

_PROTOTYPES = """
    x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    p AS (SELECT label, pos, avg(v) AS value FROM x GROUP BY 1, 2),
    v AS (SELECT label, list(value ORDER BY pos) AS proto FROM p GROUP BY 1),
    s AS (SELECT vec_id, v.label AS label, list_cosine_similarity(embedding::DOUBLE[], proto) AS score FROM embeddings e, v)
"""


def _scored(spark: SparkSession, sf: str) -> tuple[list, DataFrame]:
    embeddings = table(spark, sf, "embeddings")
    labels, prototypes = scoring.prototype_table(scoring.prototype_vectors(embeddings, "label", "embedding"), "label")
    return labels, scoring.cosine_scores(embeddings.select("vec_id", "embedding"), "embedding", prototypes)


@query(f"WITH {_PROTOTYPES} SELECT label, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM p")
def prototype_vectors(spark: SparkSession, sf: str) -> DataFrame:
    found = scoring.prototype_vectors(table(spark, sf, "embeddings"), "label", "embedding")
    return found.select("label", "pos", F.round("value", 6).alias("value"))


@query(f"WITH {_PROTOTYPES} SELECT vec_id, label, round(score, 6) AS score FROM s")
def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    labels, scored = _scored(spark, sf)
    cells = scored.select("vec_id", F.posexplode("scores").alias("pos", "score"))
    named = F.array(*[F.lit(v) for v in labels])
    return cells.select("vec_id", named[F.col("pos")].alias("label"), F.round("score", 6).alias("score"))


@query(
    f"""
    WITH {_PROTOTYPES}, b AS (SELECT vec_id, arg_max(label, score) AS label, max(score) AS score FROM s GROUP BY 1)
    SELECT vec_id, CASE WHEN score >= {THRESHOLD} THEN 'L' || label ELSE 'OTHER' END AS dimension,
           CASE WHEN score > 0.25 THEN 'L' || label ELSE 'OTHER' END AS strict_dimension
    FROM b
    """
)
def classify_threshold(spark: SparkSession, sf: str) -> DataFrame:
    labels, scored = _scored(spark, sf)
    names = [f"L{v}" for v in labels]
    return scored.select(
        "vec_id",
        scoring.classify_threshold(F.col("scores"), names, THRESHOLD, OTHER).alias("dimension"),
        scoring.classify_threshold(F.col("scores"), names, 0.25, OTHER, strict=True).alias("strict_dimension"),
    )


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class FROM embeddings")
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", vectors.argmax_index(F.col("embedding")).alias("class"))


@query(
    """
    WITH b AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings),
         d AS (SELECT doc_id, text FROM documents)
    SELECT vec_id, CAST(best % 3 - 1 AS DOUBLE) AS class_score,
           CASE WHEN text IS NULL OR length(trim(text)) < 2 THEN 0 ELSE (best % 5 - 2) / 2.0::DOUBLE END AS star_score
    FROM b LEFT JOIN d ON vec_id = doc_id
    """
)
def score_map(spark: SparkSession, sf: str) -> DataFrame:
    # The vector's largest entry stands for a class and for stars; the rated text is the document.
    best = table(spark, sf, "embeddings").select("vec_id", vectors.argmax_index(F.col("embedding")).alias("best"))
    # Whether a text is short is settled in its scan; texts do not meet the join.
    rated = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.when(F.length(F.trim("text")) >= 2, "rated").alias("said"))
    return best.join(rated, "vec_id", "left").select(
        "vec_id",
        scoring.score_map(F.col("best") % 3, CLASS_SCORES).alias("class_score"),
        scoring.star_score(F.col("best") % 5 + 1, F.col("said")).alias("star_score"),
    )


@query()
def encode_text(spark: SparkSession, sf: str) -> DataFrame:
    encoded = scoring.encode_text(text_table(spark, sf, "documents").select("doc_id", "text"), "text", width=1024)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return encoded.select("doc_id", F.size(F.filter("vector", lambda x: x != 0)).alias("n_terms"), F.round(norm, 6).alias("norm"))


@query()
def sentiment_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents").select("doc_id", "text")
    rated = docs.join(table(spark, sf, "labels"), "doc_id")
    # Three classes: toxic, plain, good.
    rated = rated.withColumn("class", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1))
    scored = scoring.sentiment_model(docs, "text", scoring.train_sentiment(rated, "text", "class"), "class")
    return scored.select("doc_id", "class", scoring.score_map(F.col("class"), CLASS_SCORES).alias("sentiment"))


# Polarity of the function words per language.
LEXICON = [(lang, w, round((-1) ** i * (1 - i / 12), 4)) for lang, ws in STOP_WORDS.items() for i, w in enumerate(ws)]


@query(
    f"""
    WITH l(lang, token, polarity) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in LEXICON)}),
         t AS (SELECT doc_id, lang, unnest({sql_words('text')}) AS token FROM documents WHERE length(text) >= 4),
         s AS (SELECT doc_id, sum(polarity::DECIMAL(12,6))::DOUBLE / count(*) AS s FROM t JOIN l USING (lang, token) GROUP BY 1)
    SELECT doc_id, round(coalesce(s, 0), 6) AS sentiment FROM documents LEFT JOIN s USING (doc_id)
    """
)
def lexicon_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = local_table(spark, LEXICON, "lang string, token string, polarity double")
    scored = scoring.lexicon_sentiment(text_table(spark, sf, "documents"), "doc_id", "text", "lang", lexicon)
    return scored.select("doc_id", F.round("sentiment", 6).alias("sentiment"))


@query(
    """
    SELECT event_type, event_id FROM (
      SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn
      FROM events) WHERE rn <= 1500
    """
)
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.capped_sample(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 1500)


# Search contexts and the group they stand for; one context may serve two groups.
CONTEXTS = [("click", "use"), ("view", "use"), ("purchase", "trade"), ("signup", "trade"), ("signup", "use"), ("error", "fault")]


@query(
    f"""
    WITH m(event_type, dimension) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CONTEXTS)})
    SELECT dimension, count(*) AS comments_count, round(avg(value), 6) AS avg_sentiment FROM events JOIN m USING (event_type) GROUP BY 1
    """
)
def context_rollup(spark: SparkSession, sf: str) -> DataFrame:
    mapping = local_table(spark, CONTEXTS, "event_type string, dimension string")
    rolled = scoring.context_rollup(table(spark, sf, "events"), "event_type", mapping, "value")
    return rolled.select("dimension", "comments_count", F.round("avg_sentiment", 6).alias("avg_sentiment"))
