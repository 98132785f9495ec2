"""Column functions on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(one: Column, two: Column) -> Column:
    return _sum(F.zip_with(one, two, lambda x, y: x.cast("double") * y.cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(one: Column, two: Column) -> Column:
    """One minus the cosine, in double precision; null for a null vector, NaN for a zero one."""
    lengths = norm(one) * norm(two)
    return F.when(lengths == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(dot(one, two), lengths))


def l2_normalize(vector: Column) -> Column:
    """The vector at length one, as floats; a zero vector stays."""
    length = norm(vector)
    return F.when(length == 0, vector.cast("array<float>")).otherwise(F.transform(vector, lambda x: F.try_divide(x.cast("double"), length).cast("float")))


def to_pgvector(vector: Column) -> Column:
    """The text ``[x,y,...]`` that a vector column of a relational database takes."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def from_pgvector(text: Column) -> Column:
    return F.from_json(text, "array<float>")
