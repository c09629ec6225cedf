"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siterank.session import new_path

# Bits of the fixed bitmap of ``only_hits``: 2**23 bits are 131,072 rows of two longs, whatever the input.
FILTER_BITS = 23


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, free: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return it read back, and its path for ``discard``.

    With ``free`` the shuffle files of the write are removed as soon as it has ended, as nothing reads them any more.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_FREE_SHUFFLES, "false")
    # the setting is taken up when a plan is made: the writer's own plan is made here
    spark.conf.set(_FREE_SHUFFLES, str(free).lower() if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` as a table in the warehouse, bucketed by ``key`` into as many buckets as shuffles have, and read it back.

    Joins and groups by ``key`` then read it in place and shuffle only what meets it.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    return spark.table(table)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written stages that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


def marked(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_hit``: whether ``key`` may occur in ``keys``, by a bitmap of fixed size.

    What is broadcast has a proven bound at any input size; a fuller bitmap only gives more false hits.
    """
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << FILTER_BITS))
    bit = f"cast(pmod(xxhash64(`{key}`), 64) as int)"
    words = (keys.where(F.col(key).isNotNull())
             .select(F.shiftright(slot, 6).alias("_word"), F.expr(f"shiftleft(1L, {bit})").alias("_bit"))
             .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return (df.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(words), "_word", "left")
            .withColumn("_hit", F.expr(f"coalesce((shiftright(_bits, {bit}) & 1L) = 1L, false)")).drop("_word", "_bits"))


def matching(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Left semi join of wide rows: rows that cannot match are dropped before the shuffle."""
    return marked(df, keys, key).where("_hit").drop("_hit").join(keys.select(key).distinct(), key, "left_semi")


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that a caller's names never meet an operator's own; ``select("_row.*")`` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Left anti join of wide rows: only rows that may match are shuffled, the others pass as they are. Columns may have any names."""
    named = keys.select(F.col(key).alias("_key"))
    found = marked(df.select(as_row(df), F.col(f"`{key}`").alias("_key")), named, "_key")
    rest = found.where("_hit").join(named.distinct(), "_key", "left_anti")
    return found.where("not _hit").select("_row.*").unionByName(rest.select("_row.*"))


def looked_up(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join of many rows to a table that few of them meet: only rows that may match are shuffled."""
    found = marked(df, small, key)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema if f.name != key]
    return (found.where("_hit").drop("_hit").join(small, key, "left")
            .unionByName(found.where("not _hit").drop("_hit").select("*", *others)))
