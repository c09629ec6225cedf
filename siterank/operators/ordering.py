"""Positions and row frames over groups of any size.

A plain window puts each group in one task. These operators range-partition by
(group, order) instead, so a group that holds most of the table is spread over
many tasks, and results stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from siterank.session import materialize

# Rows of one group handled by one window partition.
CHUNK_ROWS = 500_000

# Most rows of a fitted table that are broadcast.
BROADCAST_ROWS = 200_000

_ROW_BITS = 33  # monotonically_increasing_id: partition id above, row number below


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join the non-key columns of ``right`` to ``left`` on null-safe equal ``keys``."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.col(keys[0]).eqNullSafe(F.col(f"_r_{keys[0]}"))
    for k in keys[1:]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, cond, how).drop(*(f"_r_{k}" for k in keys))


def attach_fitted(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``attach`` for tables that are small as a rule, such as fitted statistics.

    ``right`` is written and its rows are counted: up to ``BROADCAST_ROWS`` of them go to every
    executor and ``left`` stays where it is, more are joined by a shuffle. Rows are numbers and short keys.
    """
    right = materialize(right, "fitted")
    return attach(left, F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, keys, how)


def sorted_slices(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Globally sorted copy of ``df`` with ``_slice`` (range partition) and ``_row`` (place in it).

    ``order`` should be unique per row: equal keys always share a slice.
    """
    tagged = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_mid", _ROW_BITS))
        .withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_mid")
    )
    return materialize(tagged, name)


def with_position(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (),
                  name: str = "seq", size: str | None = None) -> DataFrame:
    """Add the 0-based place of each row in its group (the whole table if none).

    ``order`` must end in a unique column. ``size`` also adds the group's row count.
    One range shuffle; the offsets table has at most one row per group and slice.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = sorted_slices(df, [*(F.col(g) for g in group), *order], "sorted")
    keys = [*group, "_slice"]
    per_slice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    in_group = Window.partitionBy(*group) if group else Window.partitionBy()
    offsets = per_slice.select(
        *keys,
        (F.sum("_n").over(in_group.orderBy("_slice")) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(in_group).alias("_size"),
    )
    out = [*df.columns, (F.col("_row") + F.col("_shift")).alias(name)]
    if size:
        out.append(F.col("_size").alias(size))
    return attach_fitted(rows, offsets, keys).select(*out)


def over_rows(df: DataFrame, group: Sequence[str], seq: str, before: int, after: int,
              columns: Mapping[str, Callable[[WindowSpec], Column]],
              chunk: int = CHUNK_ROWS) -> DataFrame:
    """Window columns that look ``before`` rows back and ``after`` rows ahead.

    ``seq`` must be the dense 0-based place in the group (see ``with_position``). Rows
    are cut into chunks of ``seq``; rows near a border are copied into the
    neighbouring chunk, and the copies are dropped at the end. Each function in
    ``columns`` gets the ordered window and sets its own frame.
    """
    if max(before, after) > chunk:
        raise ValueError("frame is wider than a chunk")
    own = F.floor(F.col(seq) / chunk)
    places = F.array_distinct(F.array(
        own, F.floor((F.col(seq) - after) / chunk), F.floor((F.col(seq) + before) / chunk)))
    w = Window.partitionBy(*group, "_chunk").orderBy(seq)
    wide = df.withColumn("_chunk", F.explode(places))
    wide = wide.select("*", *(fn(w).alias(n) for n, fn in columns.items()))
    return wide.filter(F.col("_chunk") == own).drop("_chunk")
