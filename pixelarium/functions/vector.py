"""Vector arithmetic on array columns, all in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """A constant array of doubles (folded once, never shipped per row)."""
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(doubles(vector), lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def all_zero(vector: Column) -> Column:
    return F.forall(vector, lambda x: x == 0)


def project(vector: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """vector @ matrix, matrix given by rows; one literal array per column of it."""
    columns = list(zip(*matrix, strict=True))
    return F.array(*[dot(vector, literal(c)) for c in columns])


def quantize(vector: Column, scale: int = 127) -> Column:
    """Symmetric int8: rint (half to even) of scale times, clipped to the scale."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.rint(x * scale), F.lit(-float(scale))), F.lit(float(scale))).cast("tinyint"))
