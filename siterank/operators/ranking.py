"""Combining predictions and ranking sites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from siterank.constants import PROPERTIES, WEIGHTS
from siterank.functions.numbers import half_up
from siterank.functions.scoring import sub_scores
from siterank.operators.ordering import attach_fitted, with_position


def override_merge(neural: DataFrame, regression: DataFrame, overrides: Mapping[str, str],
                   key: str = "site_id") -> DataFrame:
    """Regressor columns win over net columns where present: {net column: regressor column}."""
    out = neural.join(regression.select(key, *overrides.values()), key, "left")
    return out.withColumns({n: F.coalesce(F.col(r), F.col(n)) for n, r in overrides.items()})


def score_components(df: DataFrame, key: str = "site_id", weights: Mapping[str, float] | None = None) -> DataFrame:
    """(key, property, sub_score, points): why a site scores what it does."""
    weights = weights or WEIGHTS
    subs = sub_scores({p: F.col(p) for p in PROPERTIES})
    terms = [F.struct(F.lit(p).alias("property"), s.alias("sub_score"),
                      (s * (weights[p] * 100.0)).alias("points")) for p, s in subs.items()]
    return df.select(key, F.inline(F.array(*terms)))


def band_summary(df: DataFrame, band: str, group: Sequence[str], score: str = "landing_score") -> DataFrame:
    """Sites and mean score per group and band.

    Scores have two decimals: they are summed as whole hundredths, so the mean does not depend on the order of the rows.
    """
    hundredths = F.sum(F.round(F.col(score) * 100.0).cast("long")).cast("double")
    return df.groupBy(*group, band).agg(
        F.count(F.lit(1)).alias("sites"), half_up(F.try_divide(hundredths, F.count(score) * 100.0), 4).alias("mean_score"))


def top_sites(df: DataFrame, k: int, score: str = "landing_score", key: str = "site_id") -> DataFrame:
    """The k best sites; unscored sites come last."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc()).limit(k)


def rank_sites(df: DataFrame, cell: Sequence[str], score: str = "landing_score", key: str = "site_id") -> DataFrame:
    """Add ``site_rank``: place within the cell by score, ties broken by key."""
    order = [F.col(score).desc_nulls_last(), F.col(key)]
    out = with_position(df, order, list(cell), "site_rank")
    return out.withColumn("site_rank", F.col("site_rank") + 1)


def rank_scores(df: DataFrame, cell: Sequence[str], score: str = "landing_score") -> DataFrame:
    """Add ``score_rank`` and ``score_dense_rank``, shared by sites with equal scores.

    Scores have two decimals, so a cell has about ten thousand distinct ones: ranks come
    from counts per score, and no cell is ever sorted.
    """
    counts = df.groupBy(*cell, score).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*cell).orderBy(F.col(score).desc_nulls_last())
    ranks = counts.select(
        *cell, score, (F.sum("_n").over(w) - F.col("_n") + 1).alias("score_rank"),
        F.row_number().over(w).cast("long").alias("score_dense_rank"))
    return attach_fitted(df, ranks, [*cell, score])
