"""Site, raster, transect, sample and trial views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siterank.constants import LAYER_KEYS, RECORD_FIELDS
from siterank.operators.ordering import with_position
from siterank.session import new_path
from siterank.sources.readers import raster_scan
from siterank.sources.sinks import write_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(c: Column) -> Column:
    return F.round(c).cast("long")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per order; measurements come from its lines and are null without any."""
    lines = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(_whole(F.col("l_quantity"))).alias("q"),
            F.sum(_whole(F.col("l_discount") * 100)).alias("ds"),
            F.max(_whole(F.col("l_discount") * 100)).alias("dm"),
            F.sum(_whole(F.col("l_tax") * 100)).alias("tx"),
            F.max(_whole(F.col("l_extendedprice"))).alias("pm"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    key, n = F.col("o_orderkey"), F.col("n")
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.alias("site_id"),
            (F.lit(90.0) - ((key * 53) % 1800) / 10.0).alias("lat"),
            (((key * 37) % 3600) / 10.0 - 180.0).alias("lon"),
            (F.col("o_totalprice") / 25.0 - 8000.0).alias("elevation"),
            (F.col("q") / (n * 10.0)).alias("slope"),
            (F.col("pm") / 1000.0).alias("roughness"),
            (F.lit(0.1) + F.col("ds") / (n * 50.0)).alias("albedo"),
            (F.lit(-90.0) + (F.col("tx") * 10.0) / n).alias("temperature"),
            (F.lit(20.0) + F.col("dm") * 10.0).alias("tempRange"),
            (F.lit(10.0) + (F.col("c_custkey") % 700) / 10.0).alias("crustalThickness"),
            (F.lit(0.95) + F.col("tx") / (n * 1000.0)).alias("ferric"),
            (F.col("dm") / 100.0).alias("pyroxene"),
            (F.col("c_nationkey") / 25.0).alias("basalt"),
            (F.lit(0.11) + F.col("ds") / (n * 45.0)).alias("lambertAlbedo"),
            F.col("c_mktsegment").alias("region"))
    )


def edge_points(spark: SparkSession) -> DataFrame:
    """Points on and past the raster border."""
    return spark.createDataFrame(
        [(-1, 0.0, 180.0), (-2, -90.0, 0.0), (-3, 90.0, -180.0), (-4, None, 0.0)],
        "site_id long, lat double, lon double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all sites plus the border points."""
    return sites(spark, sf_dir).select("site_id", "lat", "lon").unionByName(edge_points(spark))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanlines (layer, y, width, height, pixels): one per vector, layers by label."""
    rows = with_position(table(spark, sf_dir, "embeddings"), ["vec_id"], ["label"], "y", size="height")
    keys = F.array(*(F.lit(k) for k in LAYER_KEYS))
    return rows.select(
        F.get(keys, F.col("label")).alias("layer"), "y", F.size("embedding").cast("long").alias("width"),
        "height", F.col("embedding").alias("pixels"))


def stored_raster(spark: SparkSession, sf_dir: str) -> str:
    """Path of the scanlines as a table partitioned by layer, as layers are kept in practice."""
    path = new_path(spark, "raster")
    write_table(raster(spark, sf_dir), path, partition_by=("layer",))
    return path


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored scanlines; filters on layer prune partitions."""
    return raster_scan(spark, stored_raster(spark, sf_dir))


def transect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation along tracks: (region, seq, elevation)."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("region"), "ts", "event_id", F.col("value").alias("elevation"))
    return with_position(rows, ["ts", "event_id"], ["region"]).select("region", "seq", "event_id", "elevation")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with five measured targets."""
    z = ((F.col("site_id") * 7919) % 1000) / 250.0 - 2.0
    return sites(spark, sf_dir).select(
        "*",
        (F.lit(-40.0) - F.col("elevation") / 400.0 + F.col("albedo") * 60.0
         - F.col("roughness") * 0.1 + z).alias("y_temp"),
        (F.lit(0.5) + F.col("albedo") * 8.0 + F.col("roughness") * 0.01 + (z + 2.0) * 0.1).alias("y_slope"),
        (F.lit(150.0) + F.col("tempRange") * 1.5 - F.col("albedo") * 200.0 + z * 5.0).alias("y_inertia"),
        (F.lit(0.6) + F.col("albedo") * 0.3 + z * 0.002).alias("y_dust"),
        (F.lit(2.0) + F.col("pyroxene") * 20.0 + F.col("crustalThickness") * 0.02 + z * 0.2).alias("y_water"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, source, body): complete, key-less and malformed requests."""
    full = sites(spark, sf_dir).select(
        F.col("site_id").alias("request_id"), F.lit("site").alias("source"),
        F.to_json(F.struct(*RECORD_FIELDS)).alias("body"))
    bare = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.lit("event").alias("source"), F.col("props").alias("body"))
    junk = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.lit("document").alias("source"), F.col("text").alias("body"))
    return full.unionByName(bare).unionByName(junk)


def mixed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column holding numbers for some customers and names for the others."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string"))
        .alias("raw"))


def trial_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training curves: (model, trial_id, step, val_loss, started) plus trial settings."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    rows = with_position(orders, ["o_orderdate", "o_orderkey"], ["o_custkey"], "step")
    bracket = F.col("c_custkey") % 3
    rnd = F.floor(F.col("c_custkey") / 3.0) % (bracket + 1)
    return rows.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("model"), F.col("c_custkey").alias("trial_id"), "step",
        F.col("o_totalprice").alias("val_loss"), F.col("o_orderdate").alias("started"),
        bracket.alias("bracket"), rnd.alias("round"),
        F.when(rnd > 0, F.col("c_custkey") - 3).alias("parent_id"),
        (F.col("c_nationkey") % 2 + 1).cast("long").alias("layers"),
        ((F.col("c_nationkey") % 4 + 1) * 16).cast("long").alias("units"),
        F.when(F.col("c_nationkey") < 12, "relu").otherwise("tanh").alias("activation"))


TRIAL_KEYS = ("model", "trial_id", "bracket", "round", "parent_id", "layers", "units", "activation")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trial: best loss and its step, number of steps, first start."""
    best = F.min(F.struct("val_loss", "step"))
    return (
        trial_steps(spark, sf_dir).groupBy(*TRIAL_KEYS)
        .agg(best.alias("_best"), F.max("val_loss").alias("worst"),
             F.count(F.lit(1)).alias("steps"), F.min("started").alias("started"))
        .select(*TRIAL_KEYS, F.col("_best.val_loss").alias("score"), F.col("_best.step").alias("best_step"),
                "worst", "steps", "started")
    )
