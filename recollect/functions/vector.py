"""Vector columns: ARRAY<FLOAT> or ARRAY<DOUBLE>, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product; null if either side is null or lengths differ in a way that leaves a null element."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def unit(a: Column) -> Column:
    """a / max(|a|, 1e-12)."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12))))[0]


def to_radius(a: Column, radius: float) -> Column:
    """a scaled to length `radius`; a zero vector is left as it is."""
    return F.when(norm(a) > 1e-12, F.transform(unit(a), lambda x: x * radius)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hash_embedding(text: Column, dim: int, seed: int = 0) -> Column:
    """A deterministic pseudo-random vector for a text, uniform in [-1, 1) per component, from xxhash64."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(text, i, F.lit(seed)), F.lit(2_000_003)).cast("double") / 1_000_001.5 - 1.0)
