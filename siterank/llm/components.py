"""Connected components by star contraction, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import discard, stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node around. Edges are (u, v) with u > v.

    Large: the larger neighbours of each node; small: the smaller ones and the node itself. The
    minimum is pre-aggregated before its shuffle, and the join back is one that adaptive
    execution can split, so a node with very many neighbours needs no task of its own.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = (edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
               .select(F.col("w").alias("u"), F.col("m").alias("v")))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that is not itself the smallest.

    Self-links, repeated links and nulls are ignored; no links give an empty table. Each round is
    written to the shared folder; only a row count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    now, path = stage(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                      .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "edges", free=True)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        step, next_path = stage(_stars(_stars(now, True), False), "edges", free=True)
        discard(spark, path)
        now, path = step, next_path
