"""Configuration as local relations. Derived sides carry no hint: adaptive execution broadcasts them by their measured bytes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A configuration list of this many narrow rows is some megabytes.
BROADCAST_ROWS = 200_000


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few configuration rows as a local relation: no Python workers, and Catalyst knows its size."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)
