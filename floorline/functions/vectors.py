"""Vector columns: arrays of numbers, worked on as doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the inner product: the cosine distance of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def normalise(v: Column) -> Column:
    """``v`` at unit length; a zero vector as it is."""
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / length))


def rms(samples: Column) -> Column:
    """Root mean square; 0 for no samples."""
    return F.when(F.size(samples) > 0, F.sqrt(dot(samples, samples) / F.size(samples))).otherwise(0.0)


def nearest_rank(values: Column, p: float) -> Column:
    """Of an array: the sorted value at floor(p * n), the last one at most; null if it is empty."""
    n = F.size(values)
    at = F.least(F.floor(F.lit(p) * n).cast("int"), n - 1) + 1
    return F.when(n > 0, F.element_at(F.sort_array(values), at))
