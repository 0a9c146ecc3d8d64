"""Vector arithmetic on array columns, in double precision and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays, accumulated as doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a side is null, empty or has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(b) > 0) & (norms > 0)
    return F.coalesce(F.when(usable, dot(a, b) / norms), F.lit(0.0))
