"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def sink_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per key of ``by``.

    Rows are not shuffled by key: one hot key would then be written by a single task. AQE's rebalance splits large
    keys and merges small ones instead.
    """
    writer = df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
