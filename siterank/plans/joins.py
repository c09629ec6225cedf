"""Queries over joins: raster sampling, overrides, scaler statistics, trial lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.constants import LAYER_KEYS, LAYERS
from siterank.operators import raster
from siterank.operators.ranking import override_merge
from siterank.operators.scaling import QuantileMap, robust_stats, scale_by_group
from siterank.operators.tuning import lineage
from siterank.plans.registry import POINTS, RASTER, SAMPLES, SITES, TRIALS, query, r, rs
from siterank.sources import readers, views

# One value per point and layer, null off the raster or without a raster.
SAMPLED = f"""{POINTS}, {RASTER},
sizes AS (SELECT layer, max(width) AS w, max(height) AS h FROM raster GROUP BY 1),
keys AS (SELECT unnest([{', '.join(f"'{k}'" for k in LAYER_KEYS)}]) AS layer),
asked AS (
  SELECT site_id, k.layer, CAST(floor((lon + 180E0)/360E0*w) AS BIGINT) AS x,
         CAST(floor((90E0 - lat)/180E0*h) AS BIGINT) AS y, w
  FROM points CROSS JOIN keys k LEFT JOIN sizes s ON s.layer = k.layer),
sampled AS (
  SELECT a.site_id, a.layer, CASE WHEN a.x >= 0 AND a.x < a.w THEN CAST(r.pixels[a.x+1] AS DOUBLE) END AS value
  FROM asked a LEFT JOIN raster r ON r.layer = a.layer AND r.y = a.y)"""

WIDE = SAMPLED + """,
wide AS (SELECT site_id, """ + ", ".join(
    f"max(CASE WHEN layer = '{k}' THEN value END) AS \"{k}\"" for k in LAYER_KEYS) + """
  FROM sampled GROUP BY site_id)"""

CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{n}', '{u}', '{d}')" for k, n, _, u, d in LAYERS) + ") AS c(layer, name, unit, description))"


def doubles(df, columns=LAYER_KEYS):
    return df.select("site_id", *(F.col(c).cast("double").alias(c) for c in columns))


@query("sample_raster", f"WITH {SAMPLED} SELECT site_id, value FROM sampled WHERE layer = 'elevation'")
def sample_raster(spark, sf):
    out = raster.sample_layer(views.points(spark, sf), views.layers(spark, sf), "elevation")
    return out.select("site_id", F.col("value").cast("double").alias("value"))


@query("coregister_layers", f"WITH {WIDE} SELECT * FROM wide")
def coregister_layers(spark, sf):
    return doubles(raster.coregister(views.points(spark, sf), views.layers(spark, sf)))


@query("coregister_layers_tiled", f"WITH {WIDE} SELECT * FROM wide")
def coregister_layers_tiled(spark, sf):
    """The plan for rasters too large to broadcast, and for any number of positions: a shuffle join with tiles."""
    return doubles(raster.coregister(views.points(spark, sf), views.layers(spark, sf), broadcast_bytes=0, few_points=0))


@query("coregister_layers_positions", f"WITH {WIDE} SELECT * FROM wide")
def coregister_layers_positions(spark, sf):
    """The plan for rasters too large to broadcast but few distinct positions: the positions go to the scanlines."""
    return doubles(raster.coregister(views.points(spark, sf), views.layers(spark, sf), broadcast_bytes=0))


@query("attach_layer_metadata", f"""WITH {SAMPLED}, {CATALOG}
SELECT site_id, layer, value, name, unit, description FROM sampled JOIN catalog USING (layer)""")
def attach_layer_metadata(spark, sf):
    wide = doubles(raster.coregister(views.points(spark, sf), views.layers(spark, sf)))
    out = raster.attach_metadata(raster.as_long(wide), readers.layer_catalog(spark))
    return out.select("site_id", "layer", "value", "name", "unit", "description")


@query("override_merge", f"""WITH {SAMPLES}
SELECT site_id, {rs('coalesce(y_temp, -70E0)')} AS surface_temp, {rs('coalesce(y_inertia, 250E0)')} AS thermal_inertia
FROM samples""")
def override_merge_query(spark, sf):
    neural = views.table(spark, sf, "orders").join(
        views.table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("site_id"), F.lit(-70.0).alias("surface_temp"), F.lit(250.0).alias("thermal_inertia"))
    regression = views.samples(spark, sf).select(
        "site_id", F.col("y_temp").alias("surface_temp_xgb"), F.col("y_inertia").alias("thermal_inertia_xgb"))
    out = override_merge(neural, regression, {"surface_temp": "surface_temp_xgb", "thermal_inertia": "thermal_inertia_xgb"})
    return out.select("site_id", r("surface_temp"), r("thermal_inertia"))


def _scaled_sql(c: str) -> str:
    m, lo, hi = (f"quantile_cont(\"{c}\", {p})" for p in (0.5, 0.25, 0.75))
    return f"{m} AS \"{c}_m\", CASE WHEN {hi} - {lo} = 0 THEN 1E0 ELSE {hi} - {lo} END AS \"{c}_s\""


SCALED = ("elevation", "albedo", "roughness")


@query("apply_scaler_join", f"""WITH {SITES},
st AS (SELECT region, {', '.join(_scaled_sql(c) for c in SCALED)} FROM sites GROUP BY region)
SELECT site_id, sites.region, {', '.join(rs(f'({c} - {c}_m)/{c}_s') + f' AS {c}' for c in SCALED)}
FROM sites JOIN st ON st.region = sites.region""")
def apply_scaler_join(spark, sf):
    sites = views.sites(spark, sf).select("site_id", "region", *SCALED)
    out = scale_by_group(sites, robust_stats(sites, SCALED, by=["region"]), ["region"], SCALED)
    return out.select("site_id", "region", *(r(c) for c in SCALED))


@query("quantile_bin_join", f"""WITH {SAMPLES},
q AS (SELECT quantile_cont(y_temp, [{', '.join(str(i / 19) for i in range(20))}]) AS g FROM samples),
edges AS (SELECT unnest(g) AS low FROM q),
steps AS (SELECT DISTINCT low FROM edges)
SELECT site_id, (SELECT count(*) FROM steps s WHERE s.low <= y_temp) - 1 AS bin
FROM samples WHERE y_temp IS NOT NULL
UNION ALL SELECT site_id, NULL FROM samples WHERE y_temp IS NULL""")
def quantile_bin_join(spark, sf):
    rows = views.samples(spark, sf).select("site_id", "y_temp")
    out = QuantileMap.fit(rows, "y_temp", 20).bins(rows, "y_temp", "bin")
    return out.select("site_id", F.col("bin").cast("long").alias("bin"))


@query("trial_lineage", f"""WITH {TRIALS}
SELECT t.model, t.trial_id, t.parent_id, t.score, p.score AS parent_score, {rs('p.score - t.score')} AS gain,
       CASE WHEN g.trial_id IS NOT NULL THEN g.trial_id WHEN p.trial_id IS NOT NULL THEN p.trial_id END AS root_id,
       CASE WHEN g.trial_id IS NOT NULL THEN 2 WHEN p.trial_id IS NOT NULL THEN 1 ELSE 0 END AS hops
FROM trials t LEFT JOIN trials p ON p.trial_id = t.parent_id LEFT JOIN trials g ON g.trial_id = p.parent_id""")
def trial_lineage(spark, sf):
    return lineage(views.trials(spark, sf)).withColumn("gain", r("gain"))
