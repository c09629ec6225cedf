"""Target transforms, their inverses, and the normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from siterank.constants import DEFAULT_TEMP_MIN, QUANTILE_EDGE
from siterank.functions.numbers import bounded


def log_target(y: Column) -> Column:
    return F.log1p(y)


def log_inverse(p: Column, clip: bool = True) -> Column:
    """Inverse of ``log_target``; serving clips at zero, training does not."""
    back = F.expm1(p)
    return bounded(back, 0.0, None) if clip else back


def shift_log_target(y: Column, lowest: Column | float) -> Column:
    return F.log1p(y - lowest + 1.0)


def shift_log_inverse(p: Column, lowest: Column | None = None) -> Column:
    """Inverse of ``shift_log_target``; a missing minimum falls back to a fixed one."""
    low = F.lit(DEFAULT_TEMP_MIN) if lowest is None else F.coalesce(lowest, F.lit(DEFAULT_TEMP_MIN))
    return F.expm1(p) + low - 1.0


def fallback_inverse(prop: str, p: Column) -> Column:
    """Inverse used when no fitted target transform exists."""
    if prop in ("slope", "water"):
        return log_inverse(p)
    if prop == "dust":
        return bounded(p * 0.2 + 0.5, 0.0, 1.0)
    if prop == "surface_temp":
        return shift_log_inverse(p)
    if prop == "thermal_inertia":
        return bounded(p * 200.0 + 400.0, 100.0, 1200.0)
    raise ValueError(f"unknown property: {prop}")


def _polynomial(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


# Hart's rational form of the normal tail (as given by West, 2005).
_CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
_CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

# Acklam's rational approximation of the normal quantile (2003).
_PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
          1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
          6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
          3.754408661907416e+00, 1.0)
_PPF_LOW = 0.02425


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, about 1e-15 accurate for |x| < 7."""
    a = F.abs(x)
    tail = F.exp(-a * a / 2.0) * _polynomial(a, _CDF_NUM) / _polynomial(a, _CDF_DEN)
    tail = F.when(a > 7.07, F.lit(0.0)).otherwise(tail)
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def with_normal_ppf(df: DataFrame, share: str, out: str) -> DataFrame:
    """Add the standard normal quantile of column ``share``.

    Shares within 1e-7 of 0 or 1 are clipped. Built in steps, so that each intermediate
    value is computed once.
    """
    df = df.withColumn("_p", F.least(F.greatest(F.col(share), F.lit(QUANTILE_EDGE)), F.lit(1.0 - QUANTILE_EDGE)))
    p = F.col("_p")
    near = F.least(p, F.lit(1.0) - p)
    df = df.withColumns({"_q": p - 0.5, "_t": F.sqrt(F.log(near) * -2.0)})
    q, t = F.col("_q"), F.col("_t")
    mid = _polynomial(q * q, _PPF_A) * q / _polynomial(q * q, _PPF_B)
    tail = _polynomial(t, _PPF_C) / _polynomial(t, _PPF_D)
    df = df.withColumn("_z", F.when(near >= _PPF_LOW, mid).when(p < 0.5, tail).otherwise(-tail))
    z = F.col("_z")
    # one Halley step brings the 1e-9 estimate to rounding error
    df = df.withColumn("_e", (normal_cdf(z) - p) * math.sqrt(2 * math.pi) * F.exp(z * z / 2.0))
    e = F.col("_e")
    return df.withColumn(out, F.when(F.col(share).isNotNull(), z - e / (z * e / 2.0 + 1.0))).drop(
        "_p", "_q", "_t", "_z", "_e")
