"""Shares, counts and trend averages per area and period."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapulse.functions.numeric import round_even, share
from areapulse.operators.sizing import local_table
from areapulse.params import OTHER


def _cells(dimensions: Sequence[str], **values: dict[str, Column]) -> Column:
    """Array of one struct per dimension from per-dimension columns, to be unfolded with ``inline``."""
    return F.array(
        *[F.struct(F.lit(d).alias("dimension"), *[v[d].alias(name) for name, v in values.items()]) for d in dimensions]
    )


def dimension_shares(df: DataFrame, area: str, dimension: str, dimensions: Sequence[str], areas: DataFrame | None = None) -> DataFrame:
    """Complete area x dimension grid: count, percentage of the area's texts, total. Empty areas get 0.

    Every text of an area is in the total; one with a null or unlisted dimension counts as OTHER where that is listed.
    One aggregate with a count per dimension of the fixed list, unfolded afterwards: each task ships one row per area,
    and the grid needs no join.
    """
    listed = F.coalesce(F.col(dimension).isin([d for d in dimensions if d != OTHER]), F.lit(False))
    counts = [F.count_if(~listed if d == OTHER else F.col(dimension) == d).alias(f"n{i}") for i, d in enumerate(dimensions)]
    per_area = df.groupBy(area).agg(*counts, F.count(F.lit(1)).alias("_texts"))
    if areas is not None:
        per_area = areas.select(area).distinct().join(per_area, area, "left")
    n = {d: F.coalesce(f"n{i}", F.lit(0)) for i, d in enumerate(dimensions)}
    total = F.coalesce("_texts", F.lit(0))
    percentages = {d: share(c, total) for d, c in n.items()}
    return per_area.select(area, total.alias("total_posts"), F.inline(_cells(dimensions, count=n, percentage=percentages)))


def conditional_sentiment(
    df: DataFrame, area: str, dimension: str, sentiment: str, dimensions: Sequence[str], parent: str | None = None, raw: str | None = None
) -> DataFrame:
    """Mean sentiment, mentions and share per area and dimension, 0 when none, with the area totals on each row.

    ``parent`` and ``raw`` flag rows that are parents or raw comments; the totals count them before any filter on
    the dimension (a null dimension marks a text that was dropped). One aggregate, no join.
    """
    parents, raws = (F.lit(0).cast("long") if c is None else F.count_if(F.col(c)) for c in (parent, raw))
    cells = []
    for i, d in enumerate(dimensions):
        here = F.col(dimension) == d
        cells += [F.count_if(here).alias(f"n{i}"), F.sum(F.when(here, F.col(sentiment))).alias(f"s{i}")]
    per_area = df.groupBy(area).agg(*cells, parents.alias("videos_analyzed"), raws.alias("comments_analyzed"))
    n = {d: F.col(f"n{i}") for i, d in enumerate(dimensions)}
    total = reduce(add, n.values())
    means = {d: F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).otherwise(F.lit(0.0)) for i, d in enumerate(dimensions)}
    percentages = {d: share(c, total) for d, c in n.items()}
    unfolded = _cells(dimensions, avg_sentiment=means, mentions_count=n, percentage_of_total=percentages)
    return per_area.select(area, F.inline(unfolded), "videos_analyzed", "comments_analyzed")


def comment_counts_only(df: DataFrame, area: str, dimension: str, dimensions: Sequence[str]) -> DataFrame:
    """Texts per area and dimension of the list, 0 when none."""
    counts = [F.count_if(F.col(dimension) == d).alias(f"n{i}") for i, d in enumerate(dimensions)]
    n = {d: F.col(f"n{i}") for i, d in enumerate(dimensions)}
    return df.groupBy(area).agg(*counts).select(area, F.inline(_cells(dimensions, count=n)))


def overall_totals(df: DataFrame, area: str, dimension: str) -> DataFrame:
    """Counts per area and dimension with subtotals per area and a grand total; null marks a total."""
    return df.rollup(F.col(area), F.col(dimension).alias("dimension")).agg(F.count(F.lit(1)).alias("count"))


def keyword_period_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean value per key, half-even rounded to two places."""
    return df.groupBy(*keys).agg(round_even(F.avg(value)).alias("mean_value"))


def mean_of_means(df: DataFrame, keys: Sequence[str], collection: str, keyword: str, value: str, keywords: Sequence[str]) -> DataFrame:
    """Mean over collections of each collection's rounded mean, per key and known keyword; 0 when absent."""
    known = df.where(F.col(keyword).isin(list(keywords)))
    each = keyword_period_mean(known, [*keys, collection, keyword], value)
    both = each.groupBy(*keys, keyword).agg(round_even(F.avg("mean_value")).alias("mean_value"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(k) for k in keywords])).alias(keyword))
    return grid.join(both, [*keys, keyword], "left").na.fill(0.0, ["mean_value"])


def nonzero_dimension_mean(df: DataFrame, keys: Sequence[str], keyword: str, value: str, dimensions: dict[str, Sequence[str]]) -> DataFrame:
    """Mean of the strictly positive keyword values per dimension, half-even to two places; 0 when none."""
    pairs = [(k, d) for d, ks in dimensions.items() for k in ks]
    mapping = local_table(df.sparkSession, pairs, f"{keyword} string, dimension string")
    positive = F.when(F.col(value) > 0, F.col(value))
    return (
        df.join(F.broadcast(mapping), keyword)
        .groupBy(*keys, "dimension")
        .agg(F.coalesce(round_even(F.avg(positive)), F.lit(0.0)).alias("mean_value"))
    )


def source_period_counts(df: DataFrame, keys: Sequence[str], source: str, sources: Sequence[str]) -> DataFrame:
    """Records per source and in total, per key."""
    counts = [F.count_if(F.col(source) == s).alias(f"n_{s}") for s in sources]
    return df.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("n_total"))


def topic_shares(df: DataFrame, keys: Sequence[str], probabilities: str, min_prob: float = 0.01) -> DataFrame:
    """Mean probability of each topic over the texts of a key; probabilities under ``min_prob`` count as 0."""
    at = df.select(*keys, F.posexplode(probabilities).alias("topic", "p"))
    kept = F.when(F.col("p") >= min_prob, F.col("p")).otherwise(F.lit(0.0))
    return at.groupBy(*keys, "topic").agg(F.avg(kept).alias("share"))


def dominant_topic(df: DataFrame, topic: str) -> DataFrame:
    """Texts per dominant topic with the percentage of all texts."""
    counts = df.groupBy(topic).agg(F.count(F.lit(1)).alias("count"))
    # One row per topic.
    return counts.withColumn("percentage", share(F.col("count"), F.sum("count").over(Window.partitionBy())))


def topic_exemplar(df: DataFrame, topic: str, score: str, key: str, text: str, chars: int = 150) -> DataFrame:
    """Strongest text per topic with a preview; ties by key.

    The winners are found without the texts, which are then fetched by key: no text is ever sorted.
    """
    order = Window.partitionBy(topic).orderBy(F.desc(score), F.asc(key))
    best = df.select(topic, key, score).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    preview = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(F.col(text))
    # One row per topic.
    return df.select(topic, key, text).join(F.broadcast(best), [topic, key]).select(topic, key, score, preview.alias("preview"))


def daily_counts(df: DataFrame, ts: str, flag: str) -> DataFrame:
    """Total, flagged and other records per calendar day from the first to the last, 0 for a day without rows."""
    day = F.to_date(ts)
    counts = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("flagged"))
    days = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day")
    )
    filled = days.join(counts, "day", "left").na.fill(0, ["total", "flagged"])
    return filled.withColumn("unflagged", F.col("total") - F.col("flagged"))


def flag_ratio(df: DataFrame, flag: str) -> DataFrame:
    """Flagged, total and their ratio."""
    return df.agg(
        F.count_if(F.col(flag)).alias("flagged"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg(F.col(flag).cast("int")), F.lit(0.0)).alias("ratio"),
    )


def period_mean_wide(df: DataFrame, ts: str, unit: str, series: str, value: str, names: Sequence[str]) -> DataFrame:
    """Mean per calendar period, one column per series of the fixed list."""
    return df.groupBy(F.date_trunc(unit, ts).alias("period")).pivot(series, list(names)).agg(F.avg(value))


def rolling_mean(df: DataFrame, series: str, period: str, value: str, window: int = 3) -> DataFrame:
    """Trailing mean per series; null until ``window`` periods exist. One row per series and period."""
    w = Window.partitionBy(series).orderBy(period).rowsBetween(1 - window, 0)
    full = F.count(value).over(w) == window
    return df.withColumn("rolling_mean", F.when(full, F.avg(value).over(w)))


def series_ranking(df: DataFrame, series: str, value: str) -> DataFrame:
    """Mean per series with its descending rank."""
    means = df.groupBy(series).agg(F.avg(value).alias("mean_value"))
    # One row per series.
    return means.withColumn("rank", F.rank().over(Window.partitionBy().orderBy(F.desc("mean_value"))))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair in one aggregate, long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("series_a"), F.lit(y).alias("series_b"), F.col(f"c{i}").alias("pearson")))
    return row.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, most frequent first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key)


def sorted_report(df: DataFrame, measure: str, tie: str, ascending: bool = False) -> DataFrame:
    """Report rows in the order of a measure, with their position. The report has one row per dimension or area."""
    order = F.asc(measure) if ascending else F.desc(measure)
    position = F.row_number().over(Window.partitionBy().orderBy(order, tie))
    return df.withColumn("position", position).orderBy("position")
