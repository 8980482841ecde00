"""Unions, dates, pivots, joins of series and panels, report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapulse.functions.text import SPACE, nfc, snake_name
from areapulse.operators.ranking import value_ranks
from areapulse.operators.sizing import local_table
from areapulse.params import DEFAULT_PALETTE, PALETTES


def canonical_key(col: Column, aliases: Mapping[str, str]) -> Column:
    """Trimmed, composed (NFC) and mapped to the canonical name."""
    key = nfc(F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+$", ""))
    names = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(names[key], key)


def union_align(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union of sources with different columns, tagged; missing columns are null."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("source_name", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def parse_rfc822(col: Column) -> Column:
    """``Thu, 02 Jan 2020 03:04:05 GMT`` to a timestamp; null if it is none.

    The weekday is cut off: the parser does not accept it, and it adds nothing.
    """
    return F.try_to_timestamp(F.regexp_replace(col, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))


def parse_iso_at_eight(col: Column) -> Column:
    """ISO date to 08:00 of that day; null if it is none."""
    day = F.date_trunc("day", F.try_to_timestamp(F.substring(col, 1, 10), F.lit("yyyy-MM-dd")))
    return day + F.expr("interval 8 hours")


def period_filter(df: DataFrame, ts: str, years: Sequence[int]) -> DataFrame:
    """Rows of the target years with a ``year`` column. Also a range on the timestamp, which the scan can prune on."""
    lo, hi = f"{min(years)}-01-01", f"{max(years) + 1}-01-01"
    inside = (F.col(ts) >= F.lit(lo).cast("timestamp_ntz")) & (F.col(ts) < F.lit(hi).cast("timestamp_ntz"))
    return df.where(inside).withColumn("year", F.year(ts)).where(F.col("year").isin(list(years)))


def pivot_metrics(df: DataFrame, key: Sequence[str], dimension: str, metrics: Mapping[str, Column], values: Sequence[str]) -> DataFrame:
    """Long to wide for several metrics: columns ``{dimension}_{metric}`` in lower snake case."""
    wide = df.groupBy(*key).pivot(dimension, list(values)).agg(*[c.alias(m) for m, c in metrics.items()])
    if len(metrics) == 1:
        names = {v: f"{v}_{next(iter(metrics))}" for v in values}
    else:
        names = {f"{v}_{m}": f"{v}_{m}" for v in values for m in metrics}
    return wide.withColumnsRenamed({old: new.lower().replace(" ", "_") for old, new in names.items()})


def topic_wide(df: DataFrame, key: Sequence[str], topic: str, value: str, names: Sequence[str]) -> DataFrame:
    """Topic shares as one named column per topic."""
    wide = df.groupBy(*key).pivot(topic, list(range(len(names)))).agg(F.first(value))
    return wide.withColumnsRenamed({str(i): n for i, n in enumerate(names)})


def project_rename(df: DataFrame, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """Headers stripped and snake-cased, columns dropped and renamed to a contract."""
    tidy = df.toDF(*[snake_name(c) for c in df.columns])
    return tidy.drop(*drop).withColumnsRenamed(dict(rename or {}))


def derive_mean_column(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """(a + b) / 2 in place of both."""
    return df.withColumn(out, (F.col(a) + F.col(b)) / 2.0).drop(a, b)


def assemble_panel(periods: Mapping[int, Sequence[DataFrame]], key: str) -> DataFrame:
    """Inner join of every source of a period on the key, the period as ``year``, periods stacked."""
    out = None
    for year, sources in periods.items():
        joined = sources[0].withColumn("year", F.lit(year))
        for s in sources[1:]:
            joined = joined.join(s, key)
        out = joined if out is None else out.unionByName(joined)
    return out


def panel_rows(panel: DataFrame) -> DataFrame:
    """Rows per period, to check that no area was lost in the joins."""
    return panel.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


def outer_join_series(series: Mapping[str, DataFrame], ts: str, value: str) -> DataFrame:
    """Series side by side on the union of their times."""
    out = None
    for name, s in series.items():
        part = s.select(ts, F.col(value).alias(name))
        out = part if out is None else out.join(part, ts, "full_outer")
    return out


def select_features(df: DataFrame, exclude: Sequence[str] = (), contains: str | None = None, prefix: str | None = None) -> list[str]:
    """Numeric columns minus the excluded ones, by name part or prefix; absent names simply do not match."""
    numeric = [n for n, t in df.dtypes if t in ("double", "float", "bigint", "int", "smallint", "tinyint")]
    chosen = [n for n in numeric if n not in exclude]
    if contains is not None:
        chosen = [n for n in chosen if contains in n.lower()]
    return [n for n in chosen if prefix is None or n.startswith(prefix)]


def long_features(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide features to (key, feature, value)."""
    doubles = df.select(*key, *[F.col(f).cast("double").alias(f) for f in features])
    return doubles.unpivot(list(key), list(features), "feature", "value")


def null_handling(df: DataFrame, columns: Sequence[str], how: str, group: str | None = None, least: int = 10) -> DataFrame:
    """Drop rows with a null in ``columns`` or fill it with 0; groups with fewer than ``least`` rows are left out."""
    out = df.dropna(subset=list(columns)) if how == "drop" else df.fillna(0, subset=list(columns))
    if group is None:
        return out
    # The counts have one row per group, so no group is gathered to be counted.
    enough = out.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(group)
    return out.join(enough, group, "left_semi")


def unpivot_properties(df: DataFrame, area: str, properties: str) -> DataFrame:
    """Open property map to (area, parameter, value); only numeric ``value_*`` entries."""
    rows = df.select(F.col(properties)[area].alias("area"), F.explode(properties).alias("parameter", "_raw"))
    return (
        rows.where(F.col("parameter").startswith("value_"))
        .select("area", "parameter", F.expr("try_cast(_raw AS double)").alias("value"))
        .where("value is not null")
    )


def pair_official_predicted(values: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Official value beside the predicted one of the mapped parameter; unmatched official values stay."""
    pairs = local_table(values.sparkSession, list(mapping.items()), "parameter string, predicted_parameter string")
    official = values.where(~F.col("parameter").endswith("_predicted")).join(F.broadcast(pairs), "parameter", "left")
    predicted = values.where(F.col("parameter").endswith("_predicted")).select(
        "area", F.col("parameter").alias("predicted_parameter"), F.col("value").alias("predicted_value")
    )
    return official.join(predicted, ["area", "predicted_parameter"], "left")


def _palette(parameter: Column, which: int, channel: int) -> Column:
    out = None
    for patterns, start, end in PALETTES:
        hit = F.lit(False)
        for p in patterns:
            both = F.lit(True)
            for piece in p.split("+"):
                both = both & F.contains(F.lower(parameter), F.lit(piece))
            hit = hit | both
        colour = F.lit((start, end)[which][channel])
        out = F.when(hit, colour) if out is None else out.when(hit, colour)
    return out.otherwise(F.lit(DEFAULT_PALETTE[which][channel]))


def color_classes(values: DataFrame, named: Mapping[str, tuple | None] = MappingProxyType({"color": None})) -> DataFrame:
    """Colours per distinct value of a parameter: its rank on linear gradients. A single value takes the start colour.

    ``named`` gives a (start, end) for each output column; without one the palette follows the parameter's name. The
    values are ranked once for all columns.
    """
    ranks = value_ranks(values, "value", ["parameter"])
    steps = ranks.groupBy("parameter").agg(F.max("dense").alias("_top"))
    at = ranks.join(steps, "parameter")
    ratio = F.when(F.col("_top") > 1, (F.col("dense") - 1) / (F.col("_top") - 1)).otherwise(F.lit(0.0))

    def colour(colours: tuple | None) -> Column:
        hexes = []
        for channel in range(3):
            if colours is None:
                a, b = (_palette(F.col("parameter"), w, channel) for w in (0, 1))
            else:
                a, b = (F.lit(colours[w][channel]) for w in (0, 1))
            # Cut towards zero; every channel is positive.
            hexes.append(F.lpad(F.lower(F.hex(F.floor(a + (b - a) * ratio).cast("long"))), 2, "0"))
        return F.concat(F.lit("#"), *hexes)

    return at.select("parameter", "value", *[colour(c).alias(name) for name, c in named.items()])


def parameter_summary(values: DataFrame) -> DataFrame:
    """Count, distinct values, smallest and largest per parameter.

    Values are counted per (parameter, value) first, so one parameter never lands in one task.
    """
    each = values.groupBy("parameter", "value").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy("parameter").agg(
        F.sum("_n").alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def results_wide(df: DataFrame, area: str, dimension: str, actual: str, predicted: str, dimensions: Sequence[str]) -> DataFrame:
    """One row per area with ``{dimension}_actual`` and ``{dimension}_predicted``."""
    metrics = {"actual": F.first(actual), "predicted": F.first(predicted)}
    return pivot_metrics(df, [area], dimension, metrics, dimensions)
