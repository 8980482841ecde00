"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that later filters and projections read instead of repeating it.

    A filter on a plain projection is pushed below it together with the whole expression, which is then computed twice.
    An exploded one-element array stays where it is.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def explode_once(df: DataFrame, keep: Sequence[str], array: Column | str, name: str) -> DataFrame:
    """One row per element of a computed array without nulls.

    A plain explode lets the optimizer put a ``size(array) > 0`` filter below it, which computes the array a second
    time; the outer form with a null test computes it once.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def word_ngrams(tokens: Column, lengths: Sequence[int]) -> Column:
    """Word n-grams of a token array, lengths in the given order; length 1 is the array itself."""

    def of_length(t: Column, n: int) -> Column:
        if n == 1:
            return t
        none = F.array().cast("array<int>")
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(none)
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))

    return bind(tokens, lambda t: F.concat(*[of_length(t, n) for n in lengths]))
