"""The serving plan: site records to predictions, score and band."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from siterank.constants import FEATURES, FEATURES_FULL, PROPERTIES, RECORD_FIELDS, REGRESSOR_FALLBACK
from siterank.functions.features import feature_vector
from siterank.functions.scoring import band_ui, clamp, site_score
from siterank.functions.targets import fallback_inverse
from siterank.operators.clean import default_fill
from siterank.operators.dense_net import Net, net_column
from siterank.plans.state import ServingState


def predict_properties(df: DataFrame, nets: Mapping[str, Net] | ServingState, full: bool = False) -> DataFrame:
    """Add the five predicted properties as ``<property>_nn``; narrow, one pass over the rows.

    Expects the record fields. With a ``ServingState`` the inputs of a net are scaled by its
    fitted scaler and its output is inverted by its fitted target transform; what was not fitted,
    or with nets alone, takes the fixed divisors and inverses. ``<property>_source`` tells which:
    ``fitted`` if scaler and transform are, ``mixed`` if one is, else ``fallback``. The ``full``
    feature set has 0 for every missing field.
    """
    state = nets if isinstance(nets, ServingState) else ServingState(nets)
    kept = df.columns
    out = default_fill(df, zero=full)
    out = out.withColumns({f"_x_{p}": _inputs(p, state, full) for p in PROPERTIES})
    out = out.withColumns({f"_z_{p}": net_column(state.nets[p], f"_x_{p}") for p in PROPERTIES})
    for p in PROPERTIES:
        if p in state.targets:
            out = state.targets[p].inverse(out, f"_z_{p}", f"{p}_nn")
        else:
            out = out.withColumn(f"{p}_nn", fallback_inverse(p, F.col(f"_z_{p}")))
    sources = [F.lit(("fallback", "mixed", "fitted")[(p in state.scalers) + (p in state.targets)]).alias(f"{p}_source") for p in PROPERTIES]
    return out.select(*kept, "n_defaulted", *(f"{p}_nn" for p in PROPERTIES), *sources)


def _inputs(p: str, state: ServingState, full: bool) -> Column:
    if p not in state.scalers:
        return feature_vector(p, scaled=True, full=full, latitude=F.col("lat"))
    raw = feature_vector(p, full=full, latitude=F.col("lat"))
    return F.array(*((F.get(raw, F.lit(i)) - c) / s for i, (c, s) in enumerate(state.scalers[p])))


def predict_sites(df: DataFrame, nets: Mapping[str, Net] | ServingState, overrides: DataFrame | None = None,
                  key: str = "site_id", full: bool = False) -> DataFrame:
    """Record -> defaults -> vectors -> nets -> inverse -> override -> clamp -> score -> band.

    ``overrides`` may bring surface_temp_xgb and thermal_inertia_xgb per key; nulls do not
    override. Without it the fitted regressors of a ``ServingState`` give them, and a failed
    prediction is replaced by its model's constant; that plan has no shuffle.
    """
    names = {"surface_temp": "surface_temp_xgb", "thermal_inertia": "thermal_inertia_xgb"}
    state = nets if isinstance(nets, ServingState) else ServingState(nets)
    out = predict_properties(df, state, full)
    if overrides is None:
        for p, c in names.items():
            if p in state.regressors:
                out = state.regressors[p].predict(out, c)
                out = out.withColumn(c, F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(REGRESSOR_FALLBACK[p])))
            else:
                out = out.withColumn(c, F.lit(None).cast("double"))
    else:
        out = out.join(overrides.select(key, *names.values()), key, "left")
    merged = {p: F.coalesce(F.col(names[p]), F.col(f"{p}_nn")) if p in names else F.col(f"{p}_nn")
              for p in PROPERTIES}
    final = clamp(merged)
    raw = F.struct(*(F.col(f) for f in RECORD_FIELDS)).alias("raw")
    carried = [c for c in df.columns if c not in RECORD_FIELDS]
    scored = out.select(*carried, raw, "n_defaulted", *names.values(), *(c.alias(p) for p, c in final.items()),
                        *(f"{p}_source" for p in PROPERTIES))
    score = site_score({p: F.col(p) for p in PROPERTIES})
    return scored.withColumn("landing_score", score).withColumn("band", band_ui(F.col("landing_score")))


def rule_nets(full: bool = False, units: int = 3) -> dict[str, Net]:
    """Small nets with weights given by a rule, for checks that need no training."""
    import numpy as np

    nets = {}
    for n, p in enumerate(PROPERTIES):
        width = len((FEATURES_FULL if full else FEATURES)[p])
        w1 = np.array([[((7 * i + 5 * j + n) % 11 - 5) / 10.0 for j in range(units)] for i in range(width)])
        b1 = np.array([(j - 1) / 10.0 for j in range(units)])
        w2 = np.array([[((3 * j + n) % 7 + 1) / 10.0] for j in range(units)])
        nets[p] = Net((w1, w2), (b1, np.array([0.2 + n / 10.0])), "relu")
    return nets
