"""Regression metrics and distributions as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siterank.functions.numbers import percent_round


def r2(y: str, p: str) -> Column:
    """Coefficient of determination: 1 - residual over total sum of squares, in one pass."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    residual = F.sum(F.when(both, (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))))
    total = F.var_pop(F.when(both, F.col(y))) * F.count_if(both)
    return F.lit(1.0) - F.try_divide(residual, total)


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def mse(y: str, p: str) -> Column:
    return F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) for equal-width bins; the last bin is closed; empty bins show 0."""
    data = df.select(F.col(column).alias("v")).filter("v is not null and not isnan(v)")
    span = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not span.n:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    lo, hi = (span.lo - 0.5, span.hi + 0.5) if span.lo == span.hi else (span.lo, span.hi)
    width = (hi - lo) / bins
    counts = (data.withColumn("bin", F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    every = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"), (F.col("id") * width + lo).alias("low"),
        ((F.col("id") + 1) * width + lo).alias("high"))
    return every.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n"])  # one row per bin


def extent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Common range of several columns."""
    lows, highs = [F.min(c) for c in columns], [F.max(c) for c in columns]
    return df.agg(F.least(*lows).alias("min_val"), F.greatest(*highs).alias("max_val"))


def model_comparison(predictions: DataFrame, by: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """Scores per model of long predictions (model, y, p)."""
    return predictions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), percent_round(r2(y, p)).alias("r2_percent"), mae(y, p).alias("mae"))


def cv_score(predictions: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Mean of fold scores per candidate of (candidate, fold, y, p)."""
    folds = predictions.groupBy("candidate", "fold").agg(r2(y, p).alias("_r2"))
    return folds.groupBy("candidate").agg(
        F.avg("_r2").alias("mean_r2"), F.count(F.lit(1)).alias("folds"))
