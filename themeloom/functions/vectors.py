"""Vector columns over ``array<double>``, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    # Not inside the lambda: the length would be summed again for every value.
    return F.when(n > 0, F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, m: x / m)).otherwise(v)


def fingerprint(v: Column) -> Column:
    """128-bit content key of a vector; equal vectors share it."""
    return F.concat(F.hex(F.xxhash64(v)), F.lit("."), F.hex(F.xxhash64(F.lit(1), v)))
