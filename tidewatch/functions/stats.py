"""Statistics as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantiles, two-sided 95 % and one-sided 95 %.
Z2, Z1 = 1.96, 1.6449


def wilson(k: Column, n: Column, z: float = Z2) -> tuple[Column, Column]:
    """Lower and upper bound of a share, held to 0..1; 0 for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return zero(F.greatest(F.lit(0.0), mid - half)), zero(F.least(F.lit(1.0), mid + half))


def min_n_to_clear(bar: float, z: float = Z1) -> int:
    """Least n whose one-sided upper bound at k = 0, z^2 / (n + z^2), is below bar."""
    return math.floor(z * z * (1 - bar) / bar) + 1


def p_star(c_fp: float, c_fn: float) -> float:
    return c_fp / (c_fp + c_fn)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, within 2e-7 (a rational approximation), so that no row leaves the JVM."""
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """With continuity correction; null below ten discordant pairs."""
    return F.when(b + c >= 10, F.pow(F.abs(b - c) - 1, F.lit(2)) / (b + c))
