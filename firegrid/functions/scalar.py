"""Small numeric columns shared by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it fails or is NULL."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def bin_right_closed(x: Column, edges: list[float], labels: list[int]) -> Column:
    """Label of the right-closed bin (edge[i-1], edge[i]]; the last label has no upper edge."""
    picks = list(zip(edges, labels))
    first = F.when(x <= F.lit(float(picks[0][0])), F.lit(picks[0][1]))
    chain = reduce(lambda w, p: w.when(x <= F.lit(float(p[0])), F.lit(p[1])), picks[1:], first)
    return chain.when(x.isNotNull(), F.lit(labels[-1]))


def risk_level(p: Column) -> Column:
    """High above 0.66, Medium above 0.33, else Low."""
    return F.when(p > 0.66, "High").when(p > 0.33, "Medium").when(p.isNotNull(), "Low")


# Coefficients of the published rational approximation of the
# inverse normal distribution (Acklam), absolute error below 1.2e-9.
NORM_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687,
          138.3577518672690, -30.66479806614716, 2.506628277459239)
NORM_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866,
          66.80131188771972, -13.28068155288572)
NORM_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
          -2.549732539343734, 4.374664141464968, 2.938163982698783)
NORM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
NORM_LOW = 0.02425


def _poly(coeffs, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coeffs[1:], F.lit(coeffs[0]))


def inverse_normal(p: Column) -> Column:
    """Normal quantile of a probability strictly between 0 and 1."""
    def tail(q: Column) -> Column:
        return _poly(NORM_C, q) / (_poly(NORM_D, q) * q + 1.0)

    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    q = p - 0.5
    r = q * q
    middle = _poly(NORM_A, r) * q / (_poly(NORM_B, r) * r + 1.0)
    return F.when(p < NORM_LOW, tail(low)).when(p > 1 - NORM_LOW, -tail(high)).otherwise(middle)


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson power transform; the two logarithmic limits are taken within 1e-9."""
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise(
        F.try_divide(F.pow(x + 1.0, lam) - 1.0, lam))
    two = F.lit(2.0) - lam
    down = F.when(F.abs(two) < 1e-9, -F.log1p(-x)).otherwise(
        -F.try_divide(F.pow(F.lit(1.0) - x, two) - 1.0, two))
    return F.when(x >= 0, up).otherwise(down)
