"""Classes and sentiment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areapulse.functions.text import phrase, words
from areapulse.functions.vectors import argmax_index, cosine_to
from areapulse.operators.sizing import local_table


def prototype_vectors(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label as (label, pos, value); combined per task before the shuffle."""
    return (
        df.select(label, F.posexplode(vector).alias("pos", "x"))
        .groupBy(label, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("value"))
    )


def prototype_table(prototypes: DataFrame, label: str) -> tuple[list, list[list[float]]]:
    """Labels and their vectors on the driver: classes x width numbers, whatever the data size."""
    found: dict = {}
    for row in prototypes.orderBy(label, "pos").collect():
        found.setdefault(row[label], []).append(row["value"])
    return list(found), list(found.values())


def hashing_encoder(text: str, out: str, width: int = 1024) -> Pipeline:
    """Default text encoder: hashed term weights with unit length. Expects a token array column."""
    return Pipeline(
        stages=[
            HashingTF(inputCol=text, outputCol="_tf", numFeatures=width),
            IDF(inputCol="_tf", outputCol="_idf", minDocFreq=1),
            Normalizer(inputCol="_idf", outputCol=out),
        ]
    )


def encode_text(df: DataFrame, text: str, out: str = "vector", width: int = 1024, encoder: Callable[[list[str]], Sequence] | None = None, load: Callable[[], Callable] | None = None) -> DataFrame:
    """Text to vector.

    Without an encoder the default Spark ML pipeline is fitted and applied. ``encoder`` takes a list of texts and
    returns one vector each; ``load`` builds such an encoder once per Python worker.
    """
    if encoder is None and load is None:
        tokens = df.withColumn("_words", words(F.col(text)))
        model = hashing_encoder("_words", "_vector", width).fit(tokens)
        return model.transform(tokens).withColumn(out, vector_to_array("_vector")).drop("_words", "_tf", "_idf", "_vector")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load() if load is not None else encoder
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in encode(batch.fillna("").tolist())])

    return df.withColumn(out, run(F.col(text)))


def term_counter(vocabulary: Sequence[str]) -> Callable[[list[str]], Sequence]:
    """An encoder: how often each word of a list occurs in a text."""
    place = {w: i for i, w in enumerate(vocabulary)}

    def encode(texts: list[str]) -> Sequence:
        out = np.zeros((len(texts), len(place)))
        for row, text in zip(out, texts):
            for w in re.findall(r"\w+", text.lower()):
                if w in place:
                    row[place[w]] += 1
        return out

    return encode


def phrase_prototypes(spark: SparkSession, blocks: Mapping[str, str], **encoder: object) -> tuple[list[str], list[list[float]]]:
    """Classes and their vectors: each keyword block becomes one phrase, encoded as the texts are. One row per class."""
    rows = local_table(spark, [(i, k, v) for i, (k, v) in enumerate(blocks.items())], "i int, label string, block string")
    phrases = rows.select("i", "label", phrase(F.col("block")).alias("phrase"))
    found = encode_text(phrases, "phrase", **encoder).orderBy("i").collect()
    return [r["label"] for r in found], [list(r["vector"]) for r in found]


def cosine_scores(df: DataFrame, vector: str, prototypes: Sequence[Sequence[float]], out: str = "scores") -> DataFrame:
    """Similarity of each row to every prototype, in prototype order."""
    return df.withColumn(out, cosine_to(prototypes)(F.col(vector)))


def classify_threshold(scores: Column, labels: Sequence[str], threshold: float, other: str, strict: bool = False) -> Column:
    """Label of the best score, the first one on ties; ``other`` below the threshold (at it too, if strict)."""
    best = F.array_max(scores)
    passed = best > threshold if strict else best >= threshold
    return F.when(passed, F.array(*[F.lit(v) for v in labels])[argmax_index(scores)]).otherwise(F.lit(other))


def score_map(cls: Column, values: Sequence[float]) -> Column:
    """Class index to its fixed score."""
    return F.array(*[F.lit(float(v)) for v in values])[cls]


def star_score(stars: Column, text: Column) -> Column:
    """1..5 stars to -1..1; a text of fewer than two characters scores 0."""
    blank = text.isNull() | (F.length(F.trim(text)) < 2)
    return F.when(blank, F.lit(0.0)).otherwise((stars - 3) / 2.0)


def train_sentiment(df: DataFrame, text: str, label: str, width: int = 4096) -> PipelineModel:
    """Default scorer: logistic regression on hashed words. Expects numeric class labels."""
    tokens = df.select(words(F.col(text)).alias("_words"), F.col(label).cast("double").alias("label"))
    stages = [*hashing_encoder("_words", "features", width).getStages(), LogisticRegression(maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(tokens)


def sentiment_model(df: DataFrame, text: str, model: PipelineModel | Callable[[list[str]], Sequence[int]], out: str = "class") -> DataFrame:
    """Text to class index with a fitted pipeline, or with a user function over Arrow batches."""
    if isinstance(model, PipelineModel):
        scored = model.transform(df.withColumn("_words", words(F.col(text))))
        dropped = ("_words", "_tf", "_idf", "features", "rawPrediction", "probability", "prediction")
        return scored.withColumn(out, F.col("prediction").cast("int")).drop(*dropped)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(model(batch.fillna("").tolist())), dtype="int32")

    return df.withColumn(out, run(F.col(text)))


def lexicon_sentiment(df: DataFrame, key: str, text: str, lang: str, lexicon: DataFrame) -> DataFrame:
    """(key, sentiment): mean polarity of the lexicon words of the text's language; 0 without hits or under 4 characters.

    Only keys and partial sums are shuffled, never the texts. Polarities are summed as decimals of six places, so the mean
    does not depend on the order of rows or on the join.
    """
    exact = lexicon.withColumn("polarity", F.col("polarity").cast("decimal(12,6)"))
    mean = F.sum("polarity").cast("double") / F.count("polarity")
    found = F.when(F.length(text) >= 4, words(F.col(text)))
    at = df.select(key, F.col(lang).alias("lang"), F.explode_outer(found).alias("token"))
    return (
        at.join(exact, ["lang", "token"], "left")
        .groupBy(key)
        .agg(F.when(F.count("polarity") > 0, mean).otherwise(F.lit(0.0)).alias("sentiment"))
    )


def capped_sample(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows per group, chosen by the hash of their key and so the same on every run.

    The rows of each group are counted by the first digits of the hash, which tells up to which digits the ``n`` smallest
    hashes can lie. Only rows up to there are ordered, so no task sorts a whole group. Rows with a null key come first.
    """
    hashed = df.withColumn("_h", F.coalesce(F.md5(F.col(key).cast("string")), F.lit("")))
    digits = F.substring("_h", 1, 4)
    counts = hashed.groupBy(F.col(group).alias("_g"), digits.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    # At most 65,536 rows per group.
    earlier = Window.partitionBy("_g").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_before") < n)
    cuts = cuts.groupBy("_g").agg(F.max("_d").alias("_cut"))
    near = hashed.join(cuts, F.col(group).eqNullSafe(F.col("_g"))).where(digits <= F.col("_cut"))
    order = Window.partitionBy(group).orderBy("_h", key)
    return near.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn", "_h", "_g", "_cut")


def context_rollup(df: DataFrame, context: str, mapping: DataFrame, measure: str) -> DataFrame:
    """Rows and mean measure per dimension; a row found under k contexts counts k times."""
    return (
        df.join(mapping, context)
        .groupBy("dimension")
        .agg(F.count(F.lit(1)).alias("comments_count"), F.avg(measure).alias("avg_sentiment"))
    )
