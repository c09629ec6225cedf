"""Layer names and report lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name fragment -> record field, tested in this order; a leading ! excludes.
KEY_RULES = (
    (("elevation",), "elevation"),
    (("slope",), "slope"),
    (("roughness",), "roughness"),
    (("albedo", "!lambert"), "albedo"),
    (("temperature", "!range"), "temperature"),
    (("temperaturerange",), "tempRange"),
    (("crustalthickness",), "crustalThickness"),
    (("ferric",), "ferric"),
    (("pyroxene",), "pyroxene"),
    (("basalt",), "basalt"),
    (("lambertalbedo",), "lambertAlbedo"),
)


def layer_key(name: Column) -> Column:
    """Record field for a display name; null when no rule fits."""
    flat = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    out = F
    for parts, field in KEY_RULES:
        cond = F.lit(True)
        for part in parts:
            cond = cond & (~flat.contains(part[1:]) if part.startswith("!") else flat.contains(part))
        out = out.when(cond, field)
    return out


def report_value(value: Column, unit: Column) -> Column:
    """``12.34 unit`` or ``N/A``."""
    text = F.concat(F.format_string("%.2f", value.cast("double")), F.lit(" "), unit)
    return F.when(value.isNotNull(), text).otherwise("N/A")
