"""Rounding, hashing and guarded numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(c: Column, digits: int) -> Column:
    """Round half up by floor, the same in every SQL engine."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def percent_round(c: Column) -> Column:
    """A ratio as percent with three decimals."""
    return half_up(c * 100.0, 3)


def bounded(c: Column, low: float | None, high: float | None) -> Column:
    """Clip to [low, high]; null stays null and NaN becomes ``low`` where there is one."""
    out = c
    if low is not None:
        out = F.when(F.isnan(c), F.lit(low)).otherwise(F.greatest(F.lit(low), out))
    if high is not None:
        out = F.least(F.lit(high), out)
    return F.when(c.isNotNull(), out)


def hash32(seed: int | str, *keys: Column) -> Column:
    """First 32 bits of md5 over seed and keys: repeatable on any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """Hash of the keys as a number in [0, 1)."""
    return hash32(seed, *keys) / float(1 << 32)


def coerce_numeric(c: Column) -> Column:
    """Text as double; null where it does not parse."""
    return c.try_cast("double")
