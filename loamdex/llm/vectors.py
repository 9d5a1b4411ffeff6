"""Vectors of whole numbers, as two operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & whole, F.lit(False))


def quantised(vector: str, scale: int, bound: int) -> Column:
    """floor(scale * x) of each component, not beyond ``bound`` to either side."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(bound))), F.lit(-float(bound)))).cast("int"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` components: longer vectors are cut off, shorter ones filled with zeros."""
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(lengths) * size and (lengths == size).all():
        return flat.reshape(len(lengths), size).astype(np.int64)
    out, start = np.zeros((len(lengths), size), np.int64), np.cumsum(lengths) - lengths
    at = np.arange(len(flat)) - np.repeat(start, lengths)
    inside = at < size
    out[np.repeat(np.arange(len(lengths)), lengths)[inside], at[inside]] = flat[inside]
    return out
