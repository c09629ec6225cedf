"""Robust and quantile scaling: fit is an aggregate, transform is a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from siterank.constants import QUANTILE_EDGE
from siterank.functions.targets import normal_cdf, with_normal_ppf
from siterank.operators.ordering import attach_fitted
from siterank.operators.quantiles import quantile_grid


def robust_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """(by..., feature, center, scale): median and interquartile range, zero range as 1."""
    grid = quantile_grid(df, columns, 5, by, **kw)
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("value")))
    wide = grid.groupBy(*by, "feature").agg(at(2).alias("center"), (at(3) - at(1)).alias("_iqr"))
    return wide.select(*by, "feature", "center",
                       F.when(F.col("_iqr") == 0, 1.0).otherwise(F.col("_iqr")).alias("scale"))


def robust_stats_approx(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Same from a mergeable sketch: rank error at most rows / accuracy."""
    ps = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    one = df.agg(*(F.percentile_approx(F.col(c), ps, accuracy).alias(c) for c in columns))
    long = one.unpivot([], [F.col(c) for c in columns], "feature", "_q")
    iqr = F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))
    return long.select("feature", F.get("_q", F.lit(1)).alias("center"),
                       F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def collect_stats(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Fitted state as {feature: (center, scale)}: one row per column of the table."""
    return {r.feature: (r.center, r.scale) for r in stats.select("feature", "center", "scale").collect()}


def robust_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Scale columns in place with collected statistics: no join, no shuffle."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in stats.items()})


def scale_by_group(df: DataFrame, stats: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Scale each row with the statistics of its own group."""
    wide = stats.groupBy(*by).agg(*(
        F.max(F.when(F.col("feature") == c, F.struct("center", "scale"))).alias(f"_s_{c}") for c in columns))
    out = attach_fitted(df, wide, list(by), "left")
    return out.withColumns({
        c: (F.col(c) - F.col(f"_s_{c}.center")) / F.col(f"_s_{c}.scale") for c in columns
    }).drop(*(f"_s_{c}" for c in columns))


@dataclass(frozen=True)
class QuantileMap:
    """Fitted quantile transform of one column: its evenly spaced quantiles."""

    grid: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, column: str, points: int = 1000, **kw) -> QuantileMap:
        return cls.fit_all(df, [column], points, **kw)[column]

    @classmethod
    def fit_all(cls, df: DataFrame, columns: Sequence[str], points: int = 1000, **kw) -> dict[str, QuantileMap]:
        """One pass for all columns; at most ``points`` values per column come back."""
        rows = quantile_grid(df, columns, points, **kw).collect()
        grids: dict[str, list] = {c: [None] * points for c in columns}
        for r in rows:
            grids[r.feature][r.i] = r.value
        return {c: cls(tuple(g)) for c, g in grids.items()}

    def _steps(self) -> tuple[list[float], list[float], list[float]]:
        """Distinct grid values with the first and last share each one stands for."""
        last = len(self.grid) - 1
        values, lo, hi = [], [], []
        for i, v in enumerate(self.grid):
            if values and values[-1] == v:
                hi[-1] = i / last
            else:
                values.append(v)
                lo.append(i / last)
                hi.append(i / last)
        return values, lo, hi

    def bins(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Add the index of the distinct grid value at or below ``column``, -1 below all."""
        values, _, _ = self._steps()
        splits = [float("-inf"), *values, float("inf")]
        found = Bucketizer(splits=splits, inputCol=column, outputCol="_bucket",
                           handleInvalid="keep").transform(df.withColumn(column, F.col(column).cast("double")))
        ok = F.col(column).isNotNull() & ~F.isnan(column)
        return found.withColumn(out, F.when(ok, F.col("_bucket").cast("int") - 1)).drop("_bucket")

    def uniform(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Add the interpolated share in [0, 1]; a tied grid value maps to its middle share."""
        values, lo, hi = self._steps()
        g, first, last = (F.lit(np.array(xs)) for xs in (values, lo, hi))
        k, x = F.col("_k"), F.col(column)
        here, there = F.get(g, k), F.get(g, k + 1)
        between = F.get(last, k) + (x - here) / (there - here) * (F.get(first, k + 1) - F.get(last, k))
        share = (F.when(k < 0, 0.0).when(x == values[0], 0.0).when(x >= values[-1], 1.0)
                 .when(x == here, (F.get(first, k) + F.get(last, k)) / 2.0).otherwise(between))
        return self.bins(df, column, "_k").withColumn(out, F.when(k.isNotNull(), share)).drop("_k")

    def normal(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Add the standard normal value of the share."""
        return with_normal_ppf(self.uniform(df, column, "_u"), "_u", out).drop("_u")

    def inverse(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Add the original value of a standard normal column."""
        last, g = len(self.grid) - 1, F.lit(np.array(self.grid))
        u, i, z = F.col("_u"), F.col("_i"), F.col(column)
        df = df.withColumn("_u", normal_cdf(z))
        df = df.withColumn("_i", F.least(F.floor(u * last), F.lit(last - 1)).cast("int"))
        between = F.get(g, i) + (F.get(g, i + 1) - F.get(g, i)) * (u * last - i)
        value = (F.when(z.isNull() | F.isnan(z), F.lit(None)).when(u - QUANTILE_EDGE < 0, self.grid[0])
                 .when(u + QUANTILE_EDGE > 1, self.grid[-1]).otherwise(between))
        return df.withColumn(out, value).drop("_u", "_i")


def target_min(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.min(target).alias("y_min"))
