"""Cleaning, auditing and routing of site tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siterank.constants import BAD_BODY, LOADING, NOT_JSON, REGRESSOR_FALLBACK
from siterank.functions.features import defaulted_count, filled


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip spaces around column names."""
    return df.toDF(*(c.strip() for c in df.columns))


def union_regions(regions: Mapping[str, DataFrame]) -> DataFrame:
    """Concatenate region tables by column name, with the region as provenance."""
    out = None
    for name, df in regions.items():
        part = df.withColumn("region", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def select_xy(df: DataFrame, independents: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *independents, target)


def select_positional(df: DataFrame) -> tuple[list[str], str]:
    """All but the last column are inputs, the last is the target."""
    return df.columns[:-1], df.columns[-1]


def default_fill(df: DataFrame, zero: bool = False) -> DataFrame:
    """Fill missing measurements; ``n_defaulted`` counts them."""
    fills = filled(zero)
    return df.select(*(fills[c].alias(c) if c in fills else F.col(c) for c in df.columns),
                     defaulted_count().alias("n_defaulted"))


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, n_rows, n_columns), one row per column, from one aggregate."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns),
                    F.count(F.lit(1)).alias("n_rows"))
    return counts.unpivot("n_rows", [F.col(c) for c in columns], "column", "nulls").select(
        "column", "nulls", "n_rows", F.lit(len(columns)).cast("long").alias("n_columns"))


def nonfinite_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: does any of the columns hold a NaN, does any hold an infinity."""
    def any_of(test) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(test(F.col(c)), F.lit(False))
        return F.coalesce(F.bool_or(out), F.lit(False))
    return df.agg(any_of(F.isnan).alias("any_nan"),
                  any_of(lambda c: F.abs(c) == float("inf")).alias("any_inf"))


def is_json(body: Column) -> Column:
    """Whether the text is exactly one JSON value.

    The parser stops after a first value, so the text must also parse inside an array and inside
    an object: whatever closes the one early does not close the other.
    """
    inside = (F.concat(F.lit("["), body, F.lit("]")), F.concat(F.lit('{"r":'), body, F.lit("}")))
    return F.try_parse_json(inside[0]).isNotNull() & F.try_parse_json(inside[1]).isNotNull()


def route(df: DataFrame, ready: Column | bool = True) -> DataFrame:
    """Add status and error to decoded requests (see ``sources.readers.decode_requests``)."""
    ready = F.lit(ready) if isinstance(ready, bool) else ready
    empty = F.col("body").isNull() | (F.trim("body") == "null")
    broken = F.col("_corrupt").isNotNull()
    # JSON, but not a record of numbers
    closed = F.col("body").rlike(r"(?s)^\s*(\{.*\}|\[.*\])\s*$")
    unusable = broken & closed & is_json(F.col("body"))
    cases = (
        (~ready, 503, LOADING),
        (empty, 400, BAD_BODY),
        (unusable, 500, "Record could not be read"),
        (broken, 400, NOT_JSON),
    )
    status, error = F, F
    for test, code, text in cases:
        status, error = status.when(test, code), error.when(test, text)
    return df.withColumn("status", status.otherwise(200).cast("long")).withColumn("error", error)


def fallback_predictions(df: DataFrame, neural: Mapping[str, str], regression: Mapping[str, str]) -> DataFrame:
    """Fill failed predictions: nets with 0, regressors with fixed constants.

    ``neural`` and ``regression`` map property to prediction column. Each gets a
    ``<column>_source`` of ``model`` or ``fallback``.
    """
    fills = [(c, 0.0) for c in neural.values()]
    fills += [(c, REGRESSOR_FALLBACK[p]) for p, c in regression.items()]
    out = df.withColumns({f"{c}_source": F.when(F.col(c).isNull(), "fallback").otherwise("model")
                          for c, _ in fills})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills})
