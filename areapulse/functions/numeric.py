"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(col: Column, places: int = 2) -> Column:
    """Half-even rounding on the binary double."""
    scale = float(10**places)
    return F.rint(col * scale) / scale


def share(part: Column, whole: Column) -> Column:
    """Percentage; 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def canonical_value(col: Column) -> Column:
    """Double with nulls as 0."""
    return F.coalesce(col.cast("double"), F.lit(0.0))
