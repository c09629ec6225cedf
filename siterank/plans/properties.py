"""One configurable training plan per surface property."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from siterank.functions.targets import log_inverse, log_target, shift_log_inverse, shift_log_target
from siterank.operators.metrics import mae, mse, r2
from siterank.operators.estimators import FourierRegressor, NetRegressor
from siterank.operators.ordering import with_position
from siterank.operators.regressors import gradient_boosting, model_pipeline, random_forest
from siterank.operators.scaling import QuantileMap
from siterank.operators.splitting import train_test_split
from siterank.operators.terrain import terrain_features


def _linear(settings: dict) -> Estimator:
    return LinearRegression(featuresCol="features", labelCol="label", **settings)


@dataclass(frozen=True)
class PropertySpec:
    """What to train: columns, target transform, split and estimator."""

    name: str
    target: str
    features: tuple[str, ...]
    transform: str = "none"  # none, log, shift_log or quantile
    key: tuple[str, ...] = ("site_id",)
    test_size: float = 0.2
    seed: int = 42
    quantiles: int = 1000
    leaky: bool = False  # fit the target transform before the split
    factory: Callable[[dict], Estimator] = _linear
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class TargetTransform:
    """Both directions of a fitted target transform."""

    kind: str
    lowest: float | None = None
    quantiles: QuantileMap | None = None

    @classmethod
    def fit(cls, spec: PropertySpec, df: DataFrame) -> TargetTransform:
        if spec.transform == "shift_log":
            return cls("shift_log", lowest=df.agg(F.min(spec.target)).first()[0])
        if spec.transform == "quantile":
            return cls("quantile", quantiles=QuantileMap.fit(df, spec.target, spec.quantiles))
        if spec.transform in ("none", "log"):
            return cls(spec.transform)
        raise ValueError(f"unknown transform: {spec.transform}")

    def forward(self, df: DataFrame, column: str, out: str) -> DataFrame:
        y = F.col(column)
        if self.kind == "quantile":
            return self.quantiles.normal(df, column, out)
        if self.kind == "log":
            return df.withColumn(out, log_target(y))
        if self.kind == "shift_log":
            return df.withColumn(out, shift_log_target(y, F.lit(self.lowest)))
        return df.withColumn(out, y)

    def inverse(self, df: DataFrame, column: str, out: str) -> DataFrame:
        p = F.col(column)
        if self.kind == "quantile":
            return self.quantiles.inverse(df, column, out)
        if self.kind == "log":
            return df.withColumn(out, log_inverse(p, clip=False))
        if self.kind == "shift_log":
            return df.withColumn(out, shift_log_inverse(p, F.lit(self.lowest)))
        return df.withColumn(out, p)


@dataclass(frozen=True)
class FittedProperty:
    spec: PropertySpec
    model: PipelineModel
    target: TargetTransform

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Add the prediction in the original unit; the inverse is always applied."""
        return self.target.inverse(self.model.transform(df), "prediction", out).select(*df.columns, out)


def prepare(spec: PropertySpec, df: DataFrame) -> DataFrame:
    """Needed columns only, rows with any null dropped."""
    return df.select(*spec.key, *spec.features, spec.target).na.drop("any")


def fit_property(spec: PropertySpec, df: DataFrame) -> tuple[FittedProperty, DataFrame]:
    """Clean, split, transform, scale, fit; returns the model and its held-out metrics.

    Metrics come in both spaces, since scores on a transformed target are not
    comparable with scores in the original unit.
    """
    clean = prepare(spec, df)
    train, test = train_test_split(clean, spec.key, spec.seed, spec.test_size)
    train, fit_on = train.persist(), None
    try:
        target = TargetTransform.fit(spec, clean if spec.leaky else train)
        # an estimator reads its rows many times: the transform is applied once
        fit_on = target.forward(train, spec.target, "label").select(*spec.features, "label").persist()
        fit_on.count()
        train.unpersist()
        model = model_pipeline(spec.features, spec.factory(dict(spec.settings))).fit(fit_on)
    finally:
        train.unpersist()
        if fit_on is not None:
            fit_on.unpersist()
    fitted = FittedProperty(spec, model, target)
    scored = model.transform(target.forward(test, spec.target, "label"))
    scored = target.inverse(scored.select(F.col(spec.target).alias("y"), "label", "prediction"), "prediction", "p")
    metrics = scored.agg(
        F.count(F.lit(1)).alias("n"), r2("y", "p").alias("r2"), mae("y", "p").alias("mae"),
        mse("y", "p").alias("mse"), r2("label", "prediction").alias("r2_transformed"),
        mae("label", "prediction").alias("mae_transformed"),
    ).select(F.lit(spec.name).alias("property"), F.lit(target.kind).alias("transform"), "*")
    return fitted, metrics


def measured_samples(samples: DataFrame) -> DataFrame:
    """Samples with the four terrain features of their place along the region's track (by site)."""
    return terrain_features(with_position(samples, ["site_id"], ["region"]), "elevation", ["region"])


def _net(settings: dict) -> Estimator:
    return NetRegressor(**settings)


# The five properties over the measured samples, with the inputs of their full specifications. The target of inertia stands for the
# layer of thermal inertia that other properties take as an input, and roughness for the aspect of slopes, which no layer has.
SPECS = (
    PropertySpec("slope", "y_slope", ("albedo", "y_inertia", "roughness", "ferric", "elevation_rolling_mean", "elevation_rolling_max_diff",
                                      "elevation_diff_abs", "elevation_diff2_abs"), "log",
                 factory=lambda s: random_forest("slope", **s), settings={"numTrees": 20, "maxDepth": 10}),
    PropertySpec("dust", "y_dust", ("elevation", "slope", "temperature", "y_inertia", "roughness", "albedo"), "quantile",
                 factory=_net, settings={"layers": [64, 64], "activation": "selu", "learningRate": 0.005}),
    PropertySpec("surface_temp", "y_temp", ("elevation", "albedo", "temperature", "slope", "roughness"), "shift_log",
                 factory=lambda s: gradient_boosting("surface_temp", **s), settings={"maxIter": 15, "maxDepth": 5}),
    PropertySpec("thermal_inertia", "y_inertia", ("tempRange", "albedo", "slope", "ferric"), "quantile",
                 factory=lambda s: FourierRegressor(**s), settings={"size": 100, "gamma": 0.1}),
    PropertySpec("water", "y_water", ("elevation", "lambertAlbedo", "y_inertia", "basalt", "temperature", "lat", "pyroxene", "crustalThickness"), "log",
                 factory=_net, settings={"layers": [64, 64], "activation": "tanh", "learningRate": 0.005}),
)
