"""Everything fitted that serving needs, and its store."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from siterank.constants import FEATURES
from siterank.operators.clean import default_fill
from siterank.operators.dense_net import Net
from siterank.operators.scaling import QuantileMap, collect_stats, robust_stats
from siterank.functions.features import feature_vector
from siterank.plans.properties import FittedProperty, PropertySpec, TargetTransform

NETS = "property string, activation string, layer int, inputs int, outputs int, weights array<double>, biases array<double>"
SCALERS = "property string, position int, center double, scale double"
TARGETS = "property string, kind string, lowest double, grid array<double>"
SPECS = "property string, target string, features array<string>, transform string, kind string, lowest double, grid array<double>"


@dataclass(frozen=True)
class ServingState:
    """Nets, and by property what was fitted for them; a property without an entry uses the fixed rule."""

    nets: Mapping[str, Net]
    scalers: Mapping[str, tuple[tuple[float, float], ...]] = field(default_factory=dict)
    targets: Mapping[str, TargetTransform] = field(default_factory=dict)
    regressors: Mapping[str, FittedProperty] = field(default_factory=dict)


def fit_input_scaler(sites: DataFrame, prop: str) -> tuple[tuple[float, float], ...]:
    """Median and interquartile range of each of the net's inputs, with defaults for missing measurements."""
    names = [f"_f{i}" for i in range(len(FEATURES[prop]))]
    vector = default_fill(sites).select(feature_vector(prop).alias("_x"))
    stats = collect_stats(robust_stats(vector.select(*(vector["_x"][i].alias(n) for i, n in enumerate(names))), names))
    return tuple(stats[n] for n in names)


def save_state(spark: SparkSession, state: ServingState, path: str) -> None:
    """Write all fitted state: small tables, and a folder for each regressor."""
    def put(name: str, rows: list, schema: str) -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    put("nets", [(p, n.activation, i, *w.shape, w.ravel().tolist(), b.tolist())
                 for p, n in state.nets.items() for i, (w, b) in enumerate(zip(n.weights, n.biases))], NETS)
    put("scalers", [(p, i, float(c), float(s)) for p, pairs in state.scalers.items() for i, (c, s) in enumerate(pairs)], SCALERS)
    put("targets", [(p, *_target_row(t)) for p, t in state.targets.items()], TARGETS)
    put("regressors", [(p, f.spec.target, list(f.spec.features), f.spec.transform, *_target_row(f.target))
                       for p, f in state.regressors.items()], SPECS)
    for p, f in state.regressors.items():
        f.model.write().overwrite().save(f"{path}/models/{p}")


def load_state(spark: SparkSession, path: str) -> ServingState:
    """The state as saved. A loaded specification has the default estimator factory."""
    get = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").collect()  # noqa: E731  small: fitted state
    layers: dict[str, list] = {}
    for r in sorted(get("nets", NETS), key=lambda r: (r.property, r.layer)):
        layers.setdefault(r.property, []).append((r.activation, np.array(r.weights).reshape(r.inputs, r.outputs), np.array(r.biases)))
    nets = {p: Net(tuple(w for _, w, _ in ls), tuple(b for _, _, b in ls), ls[0][0]) for p, ls in layers.items()}
    scalers: dict[str, list] = {}
    for r in sorted(get("scalers", SCALERS), key=lambda r: (r.property, r.position)):
        scalers.setdefault(r.property, []).append((r.center, r.scale))
    targets = {r.property: _target(r) for r in get("targets", TARGETS)}
    regressors = {r.property: FittedProperty(PropertySpec(r.property, r.target, tuple(r.features), r.transform),
                                             PipelineModel.load(f"{path}/models/{r.property}"), _target(r)) for r in get("regressors", SPECS)}
    return ServingState(nets, {p: tuple(v) for p, v in scalers.items()}, targets, regressors)


def _target_row(t: TargetTransform) -> tuple:
    return t.kind, None if t.lowest is None else float(t.lowest), None if t.quantiles is None else [float(v) for v in t.quantiles.grid]


def _target(row) -> TargetTransform:
    return TargetTransform(row.kind, row.lowest, None if row.grid is None else QuantileMap(tuple(row.grid)))
