"""Trend documents to keyword and dimension interest per area and year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapulse.functions.text import nfc
from areapulse.operators import indicators
from areapulse.params import TREND_KEYWORDS
from areapulse.sources.tables import scan_nested_series


def keyword_interest(docs: DataFrame, years: Sequence[int], dimensions: Mapping[str, Sequence[str]] = TREND_KEYWORDS) -> DataFrame:
    """(area, year, keyword, mean_value) over every keyword of the lists; years in UTC."""
    series = scan_nested_series(docs, ["area", "keyword_set"]).withColumn("year", F.year("ts"))
    series = series.where(F.col("year").isin(list(years))).withColumn("keyword", nfc(F.col("keyword")))
    known = [k for ks in dimensions.values() for k in ks]
    return indicators.mean_of_means(series, ["area", "year"], "keyword_set", "keyword", "value", known)


def dimension_interest(docs: DataFrame, years: Sequence[int], dimensions: Mapping[str, Sequence[str]] = TREND_KEYWORDS) -> DataFrame:
    """(area, year, dimension, mean_value): mean of the strictly positive keyword means."""
    means = keyword_interest(docs, years, dimensions)
    return indicators.nonzero_dimension_mean(means, ["area", "year"], "keyword", "mean_value", dict(dimensions))
