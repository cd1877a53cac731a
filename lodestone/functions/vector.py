"""Vector expressions over columns, in double, added from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest value of a quantised component.
FULL = 32767


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if a side is missing."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def quantize(v: Column) -> Column:
    """Components as 16-bit integers, rounded half up and clamped."""
    return F.transform(v, lambda x: F.greatest(F.lit(-FULL), F.least(F.lit(FULL), F.floor(x.cast("double") * FULL + 0.5))).cast("smallint"))


def dot_quantized(q: Column, v: Column) -> Column:
    products = F.zip_with(q, v, lambda x, y: x.cast("double") * y.cast("double") / F.lit(float(FULL)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """``v`` by its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0)))


def coverage(wanted: Column, having: Column) -> Column:
    """The share of ``wanted`` that ``having`` has; 0 if nothing is wanted."""
    found = F.size(F.filter(wanted, lambda t: F.array_contains(having, t)))
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(F.lit(0.0))
