"""Small statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def rate(k: Column, n: Column) -> Column:
    """k / n, null for an empty denominator."""
    return F.when(n > 0, k / n)


def wilson_low(k: Column, n: Column) -> Column:
    return _wilson(k, n, -1.0)


def wilson_high(k: Column, n: Column) -> Column:
    return _wilson(k, n, 1.0)


def _wilson(k: Column, n: Column, sign: float) -> Column:
    """A bound of the 95 % Wilson interval, clipped to [0, 1]."""
    p, z2 = k / n, Z95 * Z95
    centre = (p + z2 / (2.0 * n)) / (1.0 + z2 / n)
    half = Z95 * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / (1.0 + z2 / n)
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), centre + sign * half)))


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def support_needed(target: float) -> int:
    """Impostor attempts needed before a rate of ``target`` can be estimated."""
    import math

    return math.ceil(Z95 * Z95 * (1.0 - target) / target)
