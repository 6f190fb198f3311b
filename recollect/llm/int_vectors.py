"""Vectors of floats as vectors of whole numbers, so that products and distances are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component whose whole number is larger than this takes its row out: a hundred times a product of 64 components then fits a long.
MOST = 1 << 24


def usable(vector: Column, scale: int = 256) -> Column:
    """Whether the vector is there and its components are all there, finite and within +-MOST once scaled."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > MOST / scale)
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def kept_vectors(rows: DataFrame, vec_col: str, dims: int | None, scale: int = 256) -> DataFrame:
    """Rows with a usable vector (of `dims` components, if given), their vector as whole numbers."""
    v = F.col(vec_col)
    fits = usable(v, scale) if dims is None else usable(v, scale) & (F.size(v) == dims)
    return rows.where(fits).withColumn(vec_col, whole(v, scale))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column, all of `dims` components, as rows."""
    return np.asarray(column.flatten()).reshape(len(column), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly: in floats where every sum fits their 53 bits, else in longs."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a.astype(np.int64)).max()) * int(np.abs(b.astype(np.int64)).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
