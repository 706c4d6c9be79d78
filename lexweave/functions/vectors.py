"""Vector functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is 0; vectors of different lengths fail the query."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(value)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def vector_literal(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
