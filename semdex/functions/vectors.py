"""Distances and similarities of array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(v)) for v in vector])


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    terms = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either is a zero vector. Norms that are known already can be passed in."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def score(distance: Column) -> Column:
    """1 for distance 0, falling to 0 at distance 2 and beyond."""
    return F.greatest(F.lit(0.0), 1 - F.greatest(distance, F.lit(0.0)) / 2)

