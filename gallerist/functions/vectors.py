"""Vector arithmetic as column expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_NORM = 1e-8


def wide(v: Column) -> Column:
    """The vector in double precision."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length one; null for a vector shorter than 1e-8."""
    n = norm(v)
    return F.when(n >= MIN_NORM, F.transform(v, lambda x: x / n))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def half_cosine(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2, clipped to [0, 1]."""
    return clip01((1.0 - dot(a, b) / (norm(a) * norm(b))) / 2.0)


def similarity(distance: Column) -> Column:
    """Percent similarity of a half cosine distance."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * (1.0 - distance)))


def chi_square(a: Column, b: Column, cells: Column | int) -> Column:
    """Chi-square distance of two stacks of histograms, per cell, clipped."""
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + 1e-10))
    return clip01(F.lit(0.5) * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / cells)


def valid_vector(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers with a norm of at least 1e-8."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & (norm(v) >= MIN_NORM), F.lit(False))
