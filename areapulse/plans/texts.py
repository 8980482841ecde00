"""Texts to area indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapulse.functions.arrays import with_computed
from areapulse.functions.text import clean_text
from areapulse.operators import indicators, keywords, scoring, tokens
from areapulse.params import DIMENSIONS, MIN_CHARS, OTHER, THRESHOLD


def classed_by_words(df: DataFrame, text: str, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """``clean`` text and the ``dimension`` whose word list it hits most; OTHER for short texts and those without hits."""
    cleaned = with_computed(df, "clean", clean_text(F.col(text)))
    best = F.coalesce(tokens.language_route(F.col("clean"), lists, OTHER), F.lit(OTHER))
    return with_computed(cleaned, "dimension", F.when(F.length("clean") < MIN_CHARS, F.lit(OTHER)).otherwise(best))


def area_shares(df: DataFrame, area: str, text: str, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """For every area: the share of its texts per dimension."""
    return indicators.dimension_shares(classed_by_words(df, text, lists), area, "dimension", [*lists, OTHER])


def classed_by_vectors(
    df: DataFrame,
    key: str,
    text: str,
    prototypes: Sequence[Sequence[float]],
    labels: Sequence[str] = DIMENSIONS,
    threshold: float = THRESHOLD,
    strict: bool = False,
    **encoder: object,
) -> DataFrame:
    """``clean`` text and ``dimension`` from the nearest prototype. Each text is encoded once, whatever its areas."""
    cleaned = with_computed(df, "clean", clean_text(F.col(text)))
    scored = scoring.cosine_scores(scoring.encode_text(cleaned, "clean", "vector", **encoder), "vector", prototypes)
    best = scoring.classify_threshold(F.col("scores"), labels, threshold, OTHER, strict)
    short = F.length("clean") < MIN_CHARS
    return scored.withColumn("dimension", F.when(short, F.lit(OTHER)).otherwise(best)).drop("vector", "scores")


def post_shares(
    df: DataFrame,
    key: str,
    text: str,
    areas: Sequence[str],
    prototypes: Sequence[Sequence[float]],
    labels: Sequence[str] = DIMENSIONS,
    **encoder: object,
) -> DataFrame:
    """Posts -> class and area mentions -> shares per area; short posts count as OTHER.

    The mentions are tagged on the classified rows, so the two text passes share one scan.
    """
    classed = classed_by_vectors(df, key, text, prototypes, labels, **encoder)
    tagged = keywords.tag_area_mentions(classed, text, areas, ["dimension"])
    every_area = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(a) for a in areas])).alias("area"))
    return indicators.dimension_shares(tagged, "area", "dimension", [*labels, OTHER], every_area)


def comment_sentiment(df: DataFrame, area: str, key: str, text: str, sentiment: str, prototypes: Sequence[Sequence[float]], parent: str, raw: str, labels: Sequence[str] = DIMENSIONS, **encoder: object) -> DataFrame:
    """Comments and video heads -> class -> sentiment per area and dimension; short texts are left out of the shares."""
    classed = classed_by_vectors(df, key, text, prototypes, labels, **encoder)
    kept = classed.withColumn("dimension", F.when(F.length("clean") >= MIN_CHARS, F.col("dimension")))
    return indicators.conditional_sentiment(kept, area, "dimension", sentiment, [*labels, OTHER], parent, raw)
