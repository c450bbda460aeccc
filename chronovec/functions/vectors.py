"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """v / (|v| + eps): zero vectors stay zero."""
    return F.transform(v, lambda x: x / (norm(v) + eps))


def unit(v: Column) -> Column:
    """v / |v|, or v where its norm is 0."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)
