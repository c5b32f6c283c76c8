"""Vector arithmetic as built-in array expressions, and checks of vectors.

Inputs are widened to DOUBLE before any arithmetic. A distance is reported at
the precision of the stored vectors (FLOAT), so that copies of one vector tie
exactly whatever plan computed them.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot")


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda s, v: s + v,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot_product(vector, vector))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared L2 (``l2``), ``1 - cosine`` or ``1 - dot``; a zero vector has cosine 0."""
    if metric == "l2":
        return squared_l2(a, b).cast("float").cast("double")
    if metric == "cosine":
        cosine = F.coalesce(F.try_divide(dot_product(a, b), norm(a) * norm(b)), F.lit(0.0))
        return F.lit(1.0) - cosine.cast("float").cast("double")
    if metric == "dot":
        return F.lit(1.0) - dot_product(a, b).cast("float").cast("double")
    raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")


def similarity(distance_: Column) -> Column:
    """``1 / (1 + distance)``; below 0, where only ``dot`` gets, ``1 - distance``, so that nearer is always more."""
    return F.when(distance_ < 0, F.lit(1.0) - distance_).otherwise(
        F.try_divide(F.lit(1.0), F.lit(1.0) + distance_)
    )


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def length(vector: Column) -> Column:
    return F.when(vector.isNotNull(), F.size(vector))


def _count(vector: Column, test) -> Column:
    return F.when(vector.isNotNull(), F.size(F.filter(vector, test)))


def inf_count(vector: Column) -> Column:
    return _count(vector, lambda v: F.abs(v) == F.lit(float("inf")))


def nan_count(vector: Column) -> Column:
    return _count(vector, F.isnan)


def is_valid_vector(vector: Column, dim: int) -> Column:
    """Right length, no NaN, no infinity, no null entry."""
    entry_ok = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )
    return F.coalesce((length(vector) == dim) & entry_ok, F.lit(False))
