"""Global ranks without a single-task window.

Rows are range-partitioned by the key itself, whatever its type; nulls come first. Each range is numbered by itself, and
the offsets of the ranges come from one small aggregate. There is one plan for every size: a group that holds a third of
all rows spreads over a third of the ranges, and a value that occurs very often is counted before it is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapulse.session import cut_lineage


def _ranged(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with the number of their range, written once: the ranges are read for their totals and for their rows."""
    return cut_lineage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), name)


def value_ranks(df: DataFrame, value: str, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per distinct (group, value): ``n`` rows, ``before`` rows and ``dense`` distinct values below, within the group.

    ``first rank = before + 1`` and ``average rank = before + (n + 1) / 2``. A null value ranks first; a null group is one.
    With ``weight`` a row stands for so many.
    """
    group = list(group)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cut = _ranged(df.groupBy(*group, value).agg(n.alias("n")), [*group, value], "value-ranges")
    below = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "_range").orderBy(value)
    local = cut.withColumns({"_below": F.coalesce(F.sum("n").over(below), F.lit(0)), "_dense": F.row_number().over(inside)})
    totals = cut.groupBy(*group, "_range").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    # One row per group and range.
    order = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_d").over(order), F.lit(0)).alias("_start_dense"),
    )
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(starts, same).select(
        *group,
        value,
        "n",
        (F.col("_start") + F.col("_below")).alias("before"),
        (F.col("_start_dense") + F.col("_dense")).cast("long").alias("dense"),
    )


def number_rows(df: DataFrame, key: str, out: str = "row_id") -> DataFrame:
    """0-based position of each row in the order of a unique ``key`` of any ordered type; a null key comes first."""
    cut = _ranged(df, [key], "row-ranges")
    totals = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range.
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(key)
    return (
        cut.withColumn("_pos", F.row_number().over(inside))
        .join(starts, "_range")
        .withColumn(out, F.col("_start") + F.col("_pos") - 1)
        .drop("_range", "_start", "_pos")
    )
