"""Vector functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two encoders a collection may name.
LARGE_MODEL = "bge-m3"
SMALL_MODEL = "bge-small-zh-v1.5"


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def l2_normalize(vec: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    size = norm(vec)
    return F.transform(as_double(vec), lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size))


def route_model(name: Column) -> Column:
    """Encoder family of a collection's model name."""
    return F.when(F.lower(F.coalesce(name, F.lit(""))).contains("m3"), LARGE_MODEL).otherwise(SMALL_MODEL)
