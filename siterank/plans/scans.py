"""Queries over scans, sources and sinks."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from siterank.constants import PROPERTIES
from siterank.functions.numbers import half_up
from siterank.functions.scoring import site_score
from siterank.operators.raster import layer_sizes
from siterank.operators.regressors import model_pipeline
from siterank.operators.scaling import robust_stats
from siterank.plans.registry import FINITE_SQL, RASTER, SAMPLES, SITES, TRANSECT, TRIALS, query, r, rs
from siterank.session import new_path
from siterank.sources import readers, sinks, views
from siterank.sources.cache import LayerCache

TRANSECT_SCHEMA = "region string, seq long, event_id long, elevation double"


@query("csv_scan", f"WITH {TRANSECT} SELECT region, seq, event_id, elevation FROM transect")
def csv_scan(spark, sf):
    path = new_path(spark, "csv")
    sinks.write_table(views.transect(spark, sf), path, "csv")
    return readers.csv_scan(spark, path, TRANSECT_SCHEMA)


@query("csv_scan_encoding", f"WITH {TRANSECT} SELECT region, seq, elevation, 'm°' AS unit FROM transect")
def csv_scan_encoding(spark, sf):
    path = new_path(spark, "mixed")
    rows = views.transect(spark, sf).select("region", "seq", "elevation", F.lit("m°").alias("unit"))
    early = F.col("region") < "m"
    sinks.write_table(rows.filter(early), f"{path}/a", "csv", encoding="UTF-8")
    sinks.write_table(rows.filter(~early), f"{path}/b", "csv", encoding="ISO-8859-1")
    return readers.csv_scan_encoding(spark, f"{path}/*", "region string, seq long, elevation double, unit string")


@query("trim_headers", f"WITH {TRANSECT} SELECT region, seq, elevation FROM transect")
def trim_headers(spark, sf):
    path = new_path(spark, "padded")
    padded = views.transect(spark, sf).select(
        F.col("region").alias(" region"), F.col("seq").alias("seq "), F.col("elevation").alias("  elevation "))
    sinks.write_table(padded, path, "csv")
    raw = readers.csv_scan_raw(spark, path)
    return raw.select("region", F.col("seq").cast("long").alias("seq"), F.col("elevation").cast("double").alias("elevation"))


@query("raster_scan", f"""WITH {RASTER}
SELECT layer, y, x, CAST(pixels[x+1] AS DOUBLE) AS value
FROM raster, unnest(range(width)) AS p(x)""")
def raster_scan(spark, sf):
    rows = views.layers(spark, sf)
    return readers.raster_pixels(rows).select(
        "layer", "y", F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))


@query("layer_catalog", f"""WITH {RASTER},
sizes AS (SELECT layer, max(width) AS width, max(height) AS height FROM raster GROUP BY 1),
catalog AS (SELECT * FROM (VALUES
  ('elevation', 'Elevation (MOLA)', 'm'), ('slope', 'Slope', '°'), ('roughness', 'Roughness', 'm'),
  ('albedo', 'Albedo', ''), ('temperature', 'Temperature', '°C'), ('tempRange', 'Temperature Range', '°C'),
  ('crustalThickness', 'Crustal Thickness', 'km'), ('ferric', 'Ferric Content', ''), ('pyroxene', 'Pyroxene', ''),
  ('basalt', 'Basalt', ''), ('lambertAlbedo', 'Lambert Albedo', '')) AS c(layer, name, unit))
SELECT layer, name, unit, width, height FROM catalog LEFT JOIN sizes USING (layer)""")
def layer_catalog(spark, sf):
    sizes = layer_sizes(views.layers(spark, sf))
    return readers.layer_catalog(spark).join(sizes, "layer", "left").select("layer", "name", "unit", "width", "height")


@query("layer_cache", f"""WITH {RASTER},
px AS (SELECT layer, y, CAST(unnest(pixels) AS DOUBLE) AS v FROM raster WHERE layer IN ('elevation', 'slope'))
SELECT layer, count(DISTINCT y) AS lines, count(*) AS pixels, {rs('avg(v)')} AS mean FROM px GROUP BY layer""")
def layer_cache(spark, sf):
    cache = LayerCache(spark, views.stored_raster(spark, sf))
    both = cache.load("elevation").unionByName(cache.load("slope"))
    lines = both.groupBy("layer").agg(F.count(F.lit(1)).alias("lines"))
    pixels = readers.raster_pixels(cache.load("elevation").unionByName(cache.load("slope"))).groupBy("layer").agg(
        F.count(F.lit(1)).alias("pixels"), half_up(F.avg(F.col("value").cast("double")), 6).alias("mean"))
    return lines.join(pixels, "layer")


@query("decode_requests", f"""WITH {SITES}
SELECT site_id AS request_id, 'site' AS source, false AS corrupt, lat, lon, elevation, {rs('slope')} AS slope,
       {rs('temperature')} AS temperature, {rs('"lambertAlbedo"')} AS "lambertAlbedo" FROM sites
UNION ALL SELECT event_id, 'event', NOT json_valid(props), NULL, NULL, NULL, NULL, NULL, NULL FROM events
UNION ALL SELECT doc_id, 'document', NOT json_valid(text), NULL, NULL, NULL, NULL, NULL, NULL FROM documents""")
def decode_requests(spark, sf):
    out = readers.decode_requests(views.requests(spark, sf))
    return out.select("request_id", "source", F.col("_corrupt").isNotNull().alias("corrupt"), "lat", "lon",
                      "elevation", r("slope"), r("temperature"), r("lambertAlbedo"))


@query("encode_responses", f"""WITH {FINITE_SQL}
SELECT scored.site_id, landing_score IS NOT NULL AS success, landing_score, {rs('scored.slope')} AS slope,
       {rs('water')} AS water, CAST(NULL AS DOUBLE) AS xgb, elevation AS raw_elevation
FROM scored JOIN sites USING (site_id)""")
def encode_responses(spark, sf):
    sites = views.sites(spark, sf)
    raw = F.struct(*(F.col(c) for c in views.RECORD_FIELDS)).alias("raw")
    props = [(F.lit(0.6) + F.col("albedo") / 3.0).alias("dust"), F.col("temperature").alias("surface_temp"),
             (F.lit(100.0) + F.col("tempRange") * 3.0).alias("thermal_inertia"),
             (F.lit(1.0) + F.col("pyroxene") * 70.0).alias("water")]
    rows = sites.select("site_id", raw, "slope", *props).withColumns({
        "landing_score": site_score({p: F.col(p) for p in PROPERTIES}),
        "surface_temp_xgb": F.lit(None).cast("double"), "thermal_inertia_xgb": F.lit(None).cast("double")})
    docs = sinks.encode_responses(rows)
    schema = ("success boolean, landing_score double, predictions struct<neural_networks struct<slope double,"
              " water double>, regression_models struct<surface_temp_xgb double>>, raw_mars_data struct<elevation double>")
    back = docs.select("site_id", F.from_json("body", schema).alias("d"))
    return back.select(
        "site_id", "d.success", "d.landing_score", r(F.col("d.predictions.neural_networks.slope")).alias("slope"),
        r(F.col("d.predictions.neural_networks.water")).alias("water"),
        F.col("d.predictions.regression_models.surface_temp_xgb").alias("xgb"),
        F.col("d.raw_mars_data.elevation").alias("raw_elevation"))


def trial_documents(trials: DataFrame) -> DataFrame:
    """Trial rows as nested tuner documents."""
    def metric(value, step):
        seen = F.struct(F.array(value).alias("value"), step.alias("step"))
        return F.struct(F.lit("min").alias("direction"), F.array(seen).alias("observations"))
    text = lambda c: F.col(c).cast("string")
    values = F.create_map(
        F.lit("layers"), text("layers"), F.lit("units"), text("units"), F.lit("activation"), F.col("activation"),
        F.lit("tuner/bracket"), text("bracket"), F.lit("tuner/round"), text("round"),
        F.lit("tuner/trial_id"), text("parent_id"))
    metrics = F.create_map(F.lit("val_loss"), metric(F.col("score"), F.col("best_step")),
                           F.lit("loss"), metric(F.col("worst"), F.lit(0).cast("long")))
    return trials.select(
        "model", F.to_json(F.struct(
            F.col("trial_id").cast("string").alias("trial_id"),
            F.struct(values.alias("values")).alias("hyperparameters"),
            F.struct(metrics.alias("metrics")).alias("metrics"), "score", "best_step",
            F.lit("COMPLETED").alias("status"))).alias("value"))


def stored_trials(spark, sf) -> str:
    path = new_path(spark, "trials")
    trial_documents(views.trials(spark, sf)).write.partitionBy("model").text(path)
    return path


@query("trial_scan", f"""WITH {TRIALS}
SELECT model, CAST(trial_id AS VARCHAR) AS trial_id, score, best_step, 'COMPLETED' AS status,
       CAST(units AS VARCHAR) AS units, CAST(parent_id AS VARCHAR) AS parent FROM trials""")
def trial_scan(spark, sf):
    docs = readers.trial_scan(spark, stored_trials(spark, sf))
    values = F.col("hyperparameters.values")
    return docs.select("model", "trial_id", "score", "best_step", "status", values["units"].alias("units"),
                       F.try_element_at(values, F.lit("tuner/trial_id")).alias("parent"))


@query("explode_trial_metrics", f"""WITH {TRIALS}
SELECT model, CAST(trial_id AS VARCHAR) AS trial_id, 'val_loss' AS metric, best_step AS step, score AS value FROM trials
UNION ALL SELECT model, CAST(trial_id AS VARCHAR), 'loss', 0, worst FROM trials""")
def explode_trial_metrics(spark, sf):
    from siterank.operators.tuning import explode_metrics
    return explode_metrics(readers.trial_scan(spark, stored_trials(spark, sf)))


@query("table_sink", f"WITH {TRANSECT} SELECT region, seq, event_id, elevation FROM transect")
def table_sink(spark, sf):
    path = new_path(spark, "table")
    sinks.write_table(views.transect(spark, sf), path, partition_by=("region",))
    return spark.read.schema(TRANSECT_SCHEMA).parquet(path).select("region", "seq", "event_id", "elevation")


@query("scaler_store", f"""WITH {SAMPLES},
f AS (SELECT 'albedo' AS feature, albedo AS v FROM samples UNION ALL SELECT 'elevation', elevation FROM samples
      UNION ALL SELECT 'roughness', roughness FROM samples),
q AS (SELECT feature, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr
      FROM f GROUP BY feature)
SELECT 'surface_temp' AS model, feature, {rs('m')} AS center,
       {rs('CASE WHEN iqr = 0 THEN 1E0 ELSE iqr END')} AS scale FROM q""")
def scaler_store(spark, sf):
    path = new_path(spark, "scalers")
    stats = robust_stats(views.samples(spark, sf), ["albedo", "elevation", "roughness"])
    sinks.save_stats(stats.withColumn("model", F.lit("surface_temp")), path)
    back = sinks.load_stats(spark, path, "surface_temp")
    return back.select("model", "feature", r("center"), r("scale"))


@query("model_store", f"""WITH {SAMPLES}
SELECT count(*) AS n, 0E0 AS largest_difference FROM samples
WHERE elevation IS NOT NULL AND albedo IS NOT NULL AND roughness IS NOT NULL AND y_temp IS NOT NULL""")
def model_store(spark, sf):
    features = ["elevation", "albedo", "roughness"]
    rows = views.samples(spark, sf).select("site_id", *features, F.col("y_temp").alias("label")).na.drop("any")
    model = model_pipeline(features, LinearRegression()).fit(rows)
    path = new_path(spark, "model")
    sinks.save_model(model, path)
    again = sinks.load_model(path).transform(rows).select("site_id", F.col("prediction").alias("loaded"))
    both = model.transform(rows).select("site_id", "prediction").join(again, "site_id")
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.max(F.abs(F.col("prediction") - F.col("loaded"))).alias("largest_difference"))


@query("model_registry", """
WITH m AS (SELECT DISTINCT CASE WHEN c_nationkey < 12 THEN 'neural_networks' ELSE 'regression_models' END AS kind,
                  c_mktsegment AS name FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT kind, count(*) AS n_models, string_agg(name, ',' ORDER BY name) AS names FROM m GROUP BY kind""")
def model_registry(spark, sf):
    kind = F.when(F.col("activation") == "relu", "neural_networks").otherwise("regression_models")
    return sinks.model_registry(views.trials(spark, sf).select(kind.alias("kind"), F.col("model").alias("name")))
