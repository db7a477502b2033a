"""Column expressions over array<double> vectors: they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(terms: Column, step: Callable[[Column, Column], Column], start: float = 0.0) -> Column:
    return F.aggregate(terms, F.lit(start), step)


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: x * y), lambda s, x: s + x)


def sqeuclidean(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def cityblock(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda s, x: s + x)


def chebyshev(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda s, x: F.greatest(s, x))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos of the angle; null for a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "sqeuclidean": sqeuclidean,
    "euclidean": euclidean,
    "cityblock": cityblock,
    "chebyshev": chebyshev,
    "cosine": cosine,
}


def linear(columns: list[Column], weights: list[float]) -> Column:
    """Sum of weights times columns, in order; zero weights are left out."""
    out = None
    for c, w in zip(columns, weights, strict=True):
        if w:
            out = F.lit(float(w)) * c if out is None else out + F.lit(float(w)) * c
    return F.lit(0.0) if out is None else out
