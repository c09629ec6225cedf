"""Repeatable splits, folds and shuffles keyed on the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siterank.functions.numbers import hash32, hash_uniform
from siterank.operators.ordering import with_position


def is_test(seed: int, *keys: Column, test_size: float = 0.2) -> Column:
    """True for about ``test_size`` of the keys, always the same ones."""
    return hash_uniform(seed, *keys) < test_size


def train_test_split(df: DataFrame, keys: Sequence[str], seed: int = 42,
                     test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    held_out = is_test(seed, *(F.col(k) for k in keys), test_size=test_size)
    return df.filter(~held_out), df.filter(held_out)


def fold(seed: int, k: int, *keys: Column) -> Column:
    """Fold number in [0, k)."""
    return F.pmod(hash32(seed, *keys), F.lit(k)).cast("int")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "seq") -> DataFrame:
    """Place of each row in a random but repeatable order of the whole table."""
    return with_position(df, [hash32(seed, F.col(key)), F.col(key)], name=name)


def reindex(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """0-based row index in ``order``."""
    return with_position(df, list(order), name=name)


def tail_split(df: DataFrame, order: Sequence[str], fraction: float) -> DataFrame:
    """Add ``is_validation``: true for the last ``fraction`` of the rows in ``order``."""
    placed = with_position(df, list(order), name="_at", size="_rows")
    first = F.floor(F.col("_rows") * (1.0 - fraction))
    return placed.withColumn("is_validation", F.col("_at") >= first).drop("_at", "_rows")
