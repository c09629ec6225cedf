"""Suitability score, its parts and bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from siterank.constants import BANDS_DOC, BANDS_UI, CLAMPS, PROPERTIES, RANGES, WEIGHTS
from siterank.functions.numbers import bounded, half_up


def normalize(value: Column, low: float, high: float, invert: bool = False) -> Column:
    """Place of ``value`` in [low, high], clipped to [0, 1]; ``invert`` flips it. Null and NaN give null."""
    value = F.when(~F.isnan(value), value)
    share = bounded((value - low) / (high - low), 0.0, 1.0)
    return F.lit(1.0) - share if invert else share


def sub_scores(values: Mapping[str, Column]) -> dict[str, Column]:
    """Each property on the 0-1 scale of its range."""
    return {p: normalize(values[p], *RANGES[p]) for p in PROPERTIES}


def site_score(values: Mapping[str, Column], weights: Mapping[str, float | Column] | None = None) -> Column:
    """Weighted 0-100 score; null when any property is null.

    Weights are used as given, without re-normalising; none or empty means the defaults.
    """
    weights = weights or WEIGHTS
    total = None
    for p, s in sub_scores(values).items():
        w = weights[p]
        term = s * (w if isinstance(w, Column) else F.lit(float(w)))
        total = term if total is None else total + term
    return half_up(total * 100.0, 2)


def score_or_zeros(values: Mapping[str, Column]) -> Column:
    """Score where a site with any missing property counts as all zeros (scores 70)."""
    ok = F.lit(True)
    for p in PROPERTIES:
        ok = ok & values[p].isNotNull() & ~F.isnan(values[p])
    return site_score({p: F.when(ok, values[p]).otherwise(0.0) for p in PROPERTIES})


def clamp(values: Mapping[str, Column]) -> dict[str, Column]:
    """Properties limited to plausible physical ranges."""
    return {p: bounded(c, *CLAMPS[p]) for p, c in values.items()}


def _band(score: Column, bands) -> Column:
    out = None
    for bound, label in bands:
        if bound is None:
            return out.when(score.isNotNull(), label)
        out = F.when(score < bound, label) if out is None else out.when(score < bound, label)
    return out


def band_ui(score: Column) -> Column:
    """Band as shown to users."""
    return _band(score, BANDS_UI)


def band_doc(score: Column) -> Column:
    """Band as documented."""
    return _band(score, BANDS_DOC)
