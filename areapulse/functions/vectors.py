"""Vector expressions for the class scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_to(prototypes: Sequence[Sequence[float]]) -> Callable[[Column], Column]:
    """Cosine of an array column with each prototype, as array<double>.

    One Arrow batch is one matrix product, which is far cheaper than interpreted array lambdas. The prototypes are one
    vector per class, so their size does not depend on the data.
    """
    matrix = np.asarray(prototypes, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), None, dtype=object)
            keep = batch.notna().to_numpy()
            if keep.any():
                rows = np.stack(batch[keep].to_numpy()).astype(np.float64)
                length = np.linalg.norm(rows, axis=1, keepdims=True)
                rows = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
                for at, row in zip(np.flatnonzero(keep), rows @ unit.T):
                    out[at] = row
            yield pd.Series(out)

    return scores


def argmax_index(scores: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
