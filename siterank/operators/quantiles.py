"""Exact quantile grids of many columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from siterank.operators.ordering import attach, sorted_slices

# Up to this many values (rows x columns) a group's values are held as one sorted array.
PERCENTILE_VALUES = 2_000_000


def quantile_grid(df: DataFrame, columns: Sequence[str], points: int,
                  by: Sequence[str] = (), limit: int = PERCENTILE_VALUES) -> DataFrame:
    """``points`` evenly spaced quantiles per column: (by..., feature, i, p, value).

    Linear interpolation between order statistics; nulls and NaNs are ignored.
    """
    data = df.select(*by, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
                            for c in columns))
    if data.count() * len(columns) <= limit:
        return _by_array(data, columns, points, by)
    return _by_sort(data, columns, points, by)


def _by_array(data: DataFrame, columns, points, by) -> DataFrame:
    """Each group's values as one sorted array; the same arithmetic as ``_by_sort``, to the bit."""
    steps = points - 1
    sorted_values = data.groupBy(*by).agg(*(F.sort_array(F.collect_list(F.col(c) + 0.0)).alias(c) for c in columns))  # -0.0 counts as 0.0
    long = sorted_values.unpivot([F.col(b) for b in by], [F.col(c) for c in columns], "feature", "_v")
    spread = long.select(*by, "feature", "_v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("i"))
    last = "(size(_v) - 1L)"
    low = F.expr(f"get(_v, cast((i * {last}) div {steps} as int))")
    high = F.expr(f"get(_v, cast((i * {last}) div {steps} + 1 as int))")
    part = F.expr(f"(i * {last}) % {steps} / {steps}.0D")
    return spread.select(*by, "feature", "i", (F.col("i") / steps).alias("p"),
                         F.when(F.size("_v") == 0, None).when(part == 0, low).otherwise(low + (high - low) * part).alias("value"))


def _by_sort(data: DataFrame, columns, points, by) -> DataFrame:
    long = data.unpivot([F.col(b) for b in by], [F.col(c) for c in columns], "feature", "value")
    keys = [*by, "feature"]
    # one row per distinct value, so a value shared by most rows costs nothing
    counts = (long.filter(F.col("value").isNotNull())
              .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c")))
    rows = sorted_slices(counts, [F.col(k) for k in (*keys, "value")], "values").drop("_row")
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("value")
    rows = rows.withColumn("_upto", F.sum("_c").over(in_slice))
    per_slice = rows.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(*keys)
    offsets = per_slice.select(
        *keys, "_slice", (F.sum("_n").over(w.orderBy("_slice")) - F.col("_n")).alias("_shift"),
        F.sum("_n").over(w).alias("_total"))
    placed = attach(rows, offsets, [*keys, "_slice"]).select(
        *keys, "value", (F.col("_total") - 1).alias("_last"),
        (F.col("_shift") + F.col("_upto") - F.col("_c")).alias("_lo"),
        (F.col("_shift") + F.col("_upto") - 1).alias("_hi"))

    # point i sits at place i * last / steps, between places at and at + 1
    steps = points - 1
    candidates = (
        placed
        .withColumn("_from", F.expr(f"if(_last = 0, 0, greatest(0, ((_lo - 1) * {steps} + _last - 1) div nullif(_last, 0)))"))
        .withColumn("_to", F.expr(f"if(_last = 0, {steps}, least({steps}, ((_hi + 1) * {steps} - 1) div nullif(_last, 0)))"))
        .filter("_from <= _to")
        .withColumn("i", F.explode(F.sequence("_from", "_to")))
        .withColumn("_at", F.expr(f"(i * _last) div {steps}"))
    )
    return (
        candidates.groupBy(*keys, "i").agg(
            F.max(F.when(F.col("_at") >= F.col("_lo"), F.col("value"))).alias("_low"),
            F.max(F.when(F.col("_at") < F.col("_hi"), F.col("value"))).alias("_high"),
            F.max(F.expr(f"(i * _last) % {steps} / {steps}.0D")).alias("_frac"))
        .select(*keys, "i", (F.col("i") / steps).alias("p"),
                F.when(F.col("_frac") == 0, F.col("_low"))
                .otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_frac")).alias("value"))
    )
