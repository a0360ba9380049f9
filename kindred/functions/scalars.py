"""Numeric expressions of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(c: Column) -> Column:
    return F.round(c.cast("double") * 10000) / 10000


def at_least(c: Column, floor: float, kind: str = "float") -> Column:
    """c >= floor in c's own precision; not a number is never at least anything."""
    return (c >= F.lit(floor).cast(kind)) & ~F.isnan(c)


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(n / df))


def normalised(v: Column) -> Column:
    """A vector of unit length as floats; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v.cast("array<float>"))


def dot(a: Column, b: Column) -> Column:
    """Summed in double precision, given as a float; a longer vector's rest is ignored."""
    n = F.least(F.size(a), F.size(b))
    parts = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).cast("float")
