"""Model input vectors of a site record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siterank.constants import DEFAULTS, FEATURES, FEATURES_FULL


def filled(zero: bool = False) -> dict[str, Column]:
    """Measurements with defaults for missing ones; ``zero`` uses 0 for every field."""
    if zero:
        names = dict.fromkeys(("elevation", "slope", "roughness", "albedo", "temperature", "tempRange",
                               "crustalThickness", "ferric", "pyroxene", "basalt", "lambertAlbedo"), 0.0)
    else:
        names = DEFAULTS
    return {n: F.coalesce(F.col(n), F.lit(d)) for n, d in names.items()}


def defaulted_count() -> Column:
    """How many of the measurements with defaults are missing."""
    out = F.lit(0)
    for n in DEFAULTS:
        out = out + F.col(n).isNull().cast("int")
    return out.cast("long")


def _source(token: str, latitude: Column) -> Column:
    if token == "latitude":
        return latitude
    if token == "|slope|":
        return F.abs(F.col("slope"))
    if token == "|slope*0.1|":
        return F.abs(F.col("slope") * 0.1)
    return F.col(token)


def feature_vector(model: str, scaled: bool = False, full: bool = False,
                   latitude: Column | None = None) -> Column:
    """Ordered inputs of ``model`` as array<double>; ``scaled`` applies the fixed divisors.

    ``full`` picks the second feature set, where an unknown model gives eight zeros.
    """
    sets = FEATURES_FULL if full else FEATURES
    if model not in sets:
        if full:
            return F.array_repeat(F.lit(0.0), 8)
        raise ValueError(f"unknown model: {model}")
    lat = F.lit(0.0) if latitude is None else latitude
    return F.array(*(_source(token, lat) / F.lit(d) if scaled and d != 1.0 else _source(token, lat)
                     for token, d in sets[model]))


def feature_vector_by_name(model: Column, strict: bool = True) -> Column:
    """Inputs for the model named in each row; an unknown name raises, or gives zeros."""
    out = F
    for name in FEATURES:
        out = out.when(model == name, feature_vector(name))
    if strict:
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown model: "), model)).cast("array<double>"))
    return out.otherwise(F.array_repeat(F.lit(0.0), 8))
