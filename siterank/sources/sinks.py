"""Sinks and stores: tables, responses, scaler statistics, models and trial documents."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.constants import PROPERTIES, RECORD_FIELDS


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (),
                **options) -> None:
    """Write a table; CSV gets a header."""
    if fmt == "csv":
        options = {"header": True, **options}
    df.write.mode("overwrite").format(fmt).options(**options).partitionBy(*partition_by).save(path)


def save_stats(stats: DataFrame, path: str) -> None:
    """Persist fitted scaler statistics (model, feature, center, scale)."""
    stats.write.mode("overwrite").partitionBy("model").parquet(path)


def load_stats(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("model") == model) if model else rows


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_registry(models: DataFrame) -> DataFrame:
    """(kind, n_models, names) of a (kind, name) table of loaded models."""
    return models.distinct().groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def encode_responses(df: DataFrame) -> DataFrame:
    """Nested response document per scored site, as JSON in ``body``."""
    regression = F.struct("surface_temp_xgb", "thermal_inertia_xgb")
    predictions = F.struct(F.struct(*PROPERTIES).alias("neural_networks"), regression.alias("regression_models"))
    raw = F.struct(*(F.col(f"raw.{f}") for f in RECORD_FIELDS))
    doc = F.struct(F.col("landing_score").isNotNull().alias("success"), "landing_score",
                   predictions.alias("predictions"), raw.alias("raw_mars_data"))
    return df.select("site_id", F.to_json(doc).alias("body"))
