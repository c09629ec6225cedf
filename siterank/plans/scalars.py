"""Queries over scalar functions: transforms, scores, bands, geometry, reports, set union."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siterank.constants import LAYERS, RANGES, WEIGHTS
from siterank.functions import scoring, targets
from siterank.functions.geometry import latlon_of, pixel_x, pixel_y, sphere_point
from siterank.functions.layers import layer_key
from siterank.functions.numbers import percent_round
from siterank.operators import clean, metrics, raster, ranking
from siterank.operators.scaling import QuantileMap, collect_stats, robust_scale as scale, robust_stats
from siterank.plans.aggregates import PREDICTED, predicted
from siterank.plans.joins import CATALOG, SAMPLED, WIDE, doubles
from siterank.plans.registry import (
    PROPERTIES_SQL, SAMPLES, SCORED_SQL, SITES, TRANSECT, norm_sql, properties, query, r, rs, score_sql, scored)
from siterank.session import new_path
from siterank.sources import readers, views


@query("union_regions", f"""WITH {TRANSECT}
SELECT region, seq, elevation, CASE WHEN region IN ('click', 'purchase') THEN event_id END AS event_id FROM transect""")
def union_regions(spark, sf):
    """Region folders with unequal columns, read by one scan and concatenated by name."""
    rows, path = views.transect(spark, sf), new_path(spark, "regions")
    wide = F.col("region").isin("click", "purchase")
    rows.where(wide).write.partitionBy("region").parquet(path)
    rows.where(~wide).drop("event_id").write.mode("append").partitionBy("region").parquet(path)
    return readers.union_region_files(spark, path).select("region", "seq", "elevation", "event_id")


@query("log_target", f"WITH {SAMPLES} SELECT site_id, {rs('ln(1E0 + y_slope)')} AS y_log FROM samples")
def log_target(spark, sf):
    return views.samples(spark, sf).select("site_id", r(targets.log_target(F.col("y_slope"))).alias("y_log"))


@query("log_target_inverse", f"""WITH {SAMPLES}
SELECT site_id, {rs('CASE WHEN albedo IS NOT NULL THEN greatest(0E0, exp(z - albedo*10E0) - 1E0) END')} AS clipped,
       {rs('exp(z - albedo*10E0) - 1E0')} AS unclipped FROM samples""")
def log_target_inverse(spark, sf):
    z = ((F.col("site_id") * 7919) % 1000) / 250.0 - 2.0 - F.col("albedo") * 10.0
    return views.samples(spark, sf).select("site_id", r(targets.log_inverse(z)).alias("clipped"),
                                           r(targets.log_inverse(z, clip=False)).alias("unclipped"))


@query("shift_log_target", f"""WITH {SAMPLES}, m AS (SELECT min(y_temp) AS lo FROM samples)
SELECT site_id, {rs('ln(1E0 + (y_temp - lo + 1E0))')} AS y_log FROM samples, m""")
def shift_log_target(spark, sf):
    rows = views.samples(spark, sf)
    lowest = rows.agg(F.min("y_temp")).scalar()
    return rows.select("site_id", r(targets.shift_log_target(F.col("y_temp"), lowest)).alias("y_log"))


@query("shift_log_inverse", f"""WITH {SAMPLES}, m AS (SELECT min(y_temp) AS lo FROM samples)
SELECT site_id, {rs('exp(albedo*20E0) - 1E0 + lo - 1E0')} AS temp, {rs('exp(albedo*20E0) - 1E0 - 100E0 - 1E0')} AS temp_fallback
FROM samples, m""")
def shift_log_inverse(spark, sf):
    rows = views.samples(spark, sf)
    p, lowest = F.col("albedo") * 20.0, rows.agg(F.min("y_temp")).scalar()
    return rows.select("site_id", r(targets.shift_log_inverse(p, lowest)).alias("temp"),
                       r(targets.shift_log_inverse(p)).alias("temp_fallback"))


SCALED = ("elevation", "albedo", "tempRange")


@query("robust_scale", f"""WITH {SAMPLES},
s AS (SELECT {', '.join(f'quantile_cont("{c}", 0.5) AS "{c}_m", quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) AS "{c}_i"' for c in SCALED)} FROM samples)
SELECT site_id, {', '.join(rs(f'("{c}" - "{c}_m")/CASE WHEN "{c}_i" = 0 THEN 1E0 ELSE "{c}_i" END') + f' AS "{c}"' for c in SCALED)}
FROM samples, s""")
def robust_scale(spark, sf):
    rows = views.samples(spark, sf)
    return scale(rows, collect_stats(robust_stats(rows, SCALED))).select("site_id", *(r(c) for c in SCALED))


def share_sql(column: str, points: int, out: str) -> str:
    """CTEs giving (site_id, out): the interpolated share of a column on its quantile grid."""
    last = points - 1
    ps = ", ".join(str(i / last) for i in range(points))
    c = f'"{column}"'
    return f"""{out}_g AS (SELECT quantile_cont({c}, [{ps}]) AS g FROM samples),
{out}_e AS (SELECT g[i+1] AS v, i/{last}::DOUBLE AS p FROM {out}_g, unnest(range({points})) AS n(i)),
{out}_d AS (SELECT v, min(p) AS lo, max(p) AS hi FROM {out}_e GROUP BY v),
{out}_s AS (SELECT v, lo, hi, lead(v) OVER (ORDER BY v) AS nv, lead(lo) OVER (ORDER BY v) AS nlo, min(v) OVER () AS v0 FROM {out}_d),
{out}_t AS (SELECT site_id, CASE WHEN {c} = v0 THEN 0E0 WHEN nv IS NULL THEN 1E0 WHEN {c} = v THEN (lo + hi)/2E0
                ELSE hi + ({c} - v)/(nv - v)*(nlo - hi) END AS {out}
         FROM samples JOIN {out}_s ON {c} >= v AND ({c} < nv OR nv IS NULL))"""


@query("quantile_uniform", f"""WITH {SAMPLES}, {share_sql('y_temp', 20, 'a')}, {share_sql('tempRange', 20, 'b')}
SELECT s.site_id, {rs('a')} AS y_temp, {rs('b')} AS temp_range
FROM samples s LEFT JOIN a_t USING (site_id) LEFT JOIN b_t USING (site_id)""")
def quantile_uniform(spark, sf):
    rows = views.samples(spark, sf).select("site_id", "y_temp", "tempRange")
    maps = QuantileMap.fit_all(rows, ["y_temp", "tempRange"], 20)
    out = maps["y_temp"].uniform(rows, "y_temp", "a")
    out = maps["tempRange"].uniform(out, "tempRange", "b")
    return out.select("site_id", r(F.col("a")).alias("y_temp"), r(F.col("b")).alias("temp_range"))


def cdf_sql(z: str, terms: int = 90) -> str:
    """Normal distribution function as its power series, in Horner form."""
    series = "1E0"
    for k in range(terms, 0, -1):
        series = f"(1E0 + {z}*{z}/{2 * k + 1}E0*{series})"
    return f"(0.5E0 + exp(-{z}*{z}/2E0)*{1 / math.sqrt(2 * math.pi)!r}::DOUBLE*{z}*{series})"


def ppf_sql(u: str, out: str, source: str) -> str:
    """CTEs giving (site_id, out): normal quantile by a rough start and three Newton steps."""
    t = f"sqrt(-2E0*ln(least({u}p, 1E0 - {u}p)))"
    start = f"({t} - (2.515517E0 + 0.802853E0*{t} + 0.010328E0*{t}*{t})/(1E0 + 1.432788E0*{t} + 0.189269E0*{t}*{t} + 0.001308E0*{t}*{t}*{t}))"
    ctes = [f"{out}0 AS (SELECT site_id, least(greatest({u}, 1E-7), 1E0 - 1E-7) AS {u}p FROM {source})",
            f"{out}1 AS (SELECT site_id, {u}p, CASE WHEN {u}p < 0.5 THEN -{start} ELSE {start} END AS z FROM {out}0)"]
    for i in range(1, 4):
        ctes.append(f"{out}{i + 1} AS (SELECT site_id, {u}p, z - ({cdf_sql('z')} - {u}p)*{math.sqrt(2 * math.pi)!r}::DOUBLE*exp(z*z/2E0) AS z FROM {out}{i})")
    return ",\n".join(ctes)


@query("quantile_normal", f"""WITH {SAMPLES}, {share_sql('y_temp', 20, 'a')}, {ppf_sql('a', 'n', 'a_t')}
SELECT s.site_id, {rs('n4.z', 5)} AS z FROM samples s LEFT JOIN n4 USING (site_id)""")
def quantile_normal(spark, sf):
    rows = views.samples(spark, sf).select("site_id", "y_temp")
    return QuantileMap.fit(rows, "y_temp", 20).normal(rows, "y_temp", "z").select("site_id", r("z", 5))


Z = "(((site_id*7919)%1000)/125E0 - 4E0)"


@query("quantile_inverse", f"""WITH {SAMPLES},
g AS (SELECT quantile_cont(y_inertia, [{', '.join(str(i / 49) for i in range(50))}]) AS g FROM samples),
u AS (SELECT site_id, {cdf_sql('z')} AS u FROM (SELECT site_id, {Z} AS z FROM samples)),
i AS (SELECT site_id, u, CAST(least(floor(u*49E0), 48E0) AS BIGINT) AS i FROM u)
SELECT site_id, {rs('CASE WHEN u - 1E-7 < 0 THEN g[1] WHEN u + 1E-7 > 1 THEN g[50] ELSE g[i+1] + (g[i+2] - g[i+1])*(u*49E0 - i) END', 5)} AS y
FROM i, g""")
def quantile_inverse(spark, sf):
    z = ((F.col("site_id") * 7919) % 1000) / 125.0 - 4.0
    rows = views.samples(spark, sf).select("site_id", "y_inertia", z.alias("z"))
    return QuantileMap.fit(rows, "y_inertia", 50).inverse(rows, "z", "y").select("site_id", r("y", 5))


@query("inverse_fallback", f"""WITH {SAMPLES}, p AS (SELECT site_id, z FROM samples)
SELECT site_id, {rs('least(1E0, greatest(0E0, z*0.2E0 + 0.5E0))')} AS dust,
       {rs('least(1200E0, greatest(100E0, z*200E0 + 400E0))')} AS inertia, {rs('exp(z) - 1E0 - 100E0 - 1E0')} AS temp,
       {rs('greatest(0E0, exp(z) - 1E0)')} AS slope FROM p""")
def inverse_fallback(spark, sf):
    z = ((F.col("site_id") * 7919) % 1000) / 250.0 - 2.0
    names = {"dust": "dust", "inertia": "thermal_inertia", "temp": "surface_temp", "slope": "slope"}
    return views.sites(spark, sf).select(
        "site_id", *(r(targets.fallback_inverse(p, z)).alias(n) for n, p in names.items()))


@query("normalize", f"WITH {PROPERTIES_SQL} SELECT site_id, " + ", ".join(
    f"{rs(norm_sql(p, *RANGES[p]))} AS {p}" for p in RANGES) + " FROM props")
def normalize(spark, sf):
    props = properties(views.sites(spark, sf))
    return props.select("site_id", *(r(scoring.normalize(F.col(p), *RANGES[p])).alias(p) for p in RANGES))


@query("site_score", f"WITH {SCORED_SQL} SELECT site_id, landing_score FROM scored")
def site_score(spark, sf):
    return scored(views.sites(spark, sf)).select("site_id", "landing_score")


REGION_WEIGHTS = {"BUILDING": "slope", "MACHINERY": "water"}  # region -> the only weighted property


def weight_sql(p: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {1.0 if v == p else 0.0}::DOUBLE" for k, v in REGION_WEIGHTS.items())
    return f"CASE region {cases} ELSE {WEIGHTS[p]}::DOUBLE END"


@query("site_score_weighted", f"""WITH {PROPERTIES_SQL}
SELECT site_id, {score_sql({p: weight_sql(p) for p in WEIGHTS})} AS by_region,
       {score_sql({'slope': '1E0', 'dust': '0.5E0', 'surface_temp': '0.5E0', 'thermal_inertia': '0E0', 'water': '0E0'})} AS caller
FROM props""")
def site_score_weighted(spark, sf):
    """Weights per row from a weights table, and a caller's map used without re-normalising."""
    props = properties(views.sites(spark, sf))
    per_region = spark.createDataFrame(
        [(k, *(1.0 if v == p else 0.0 for p in WEIGHTS)) for k, v in REGION_WEIGHTS.items()],
        "region string, " + ", ".join(f"w_{p} double" for p in WEIGHTS))
    rows = props.join(F.broadcast(per_region), "region", "left")
    weights = {p: F.coalesce(F.col(f"w_{p}"), F.lit(w)) for p, w in WEIGHTS.items()}
    values = {p: F.col(p) for p in RANGES}
    caller = {"slope": 1.0, "dust": 0.5, "surface_temp": 0.5, "thermal_inertia": 0.0, "water": 0.0}
    return rows.select("site_id", scoring.site_score(values, weights).alias("by_region"),
                       scoring.site_score(values, caller).alias("caller"))


@query("zero_on_error", f"""WITH {PROPERTIES_SQL}
SELECT site_id, CASE WHEN slope IS NULL OR isnan(slope) OR isnan(surface_temp) THEN 70E0 ELSE {score_sql()} END AS landing_score FROM props""")
def zero_on_error(spark, sf):
    """Scores where a failed prediction counts as zeros, for parity only."""
    props = properties(views.sites(spark, sf))
    return props.select("site_id", scoring.score_or_zeros({p: F.col(p) for p in RANGES}).alias("landing_score"))


@query("score_components", f"WITH {PROPERTIES_SQL} " + " UNION ALL ".join(
    f"SELECT site_id, '{p}' AS property, {rs(norm_sql(p, *RANGES[p]))} AS sub_score, "
    f"{rs(f'({norm_sql(p, *RANGES[p])})*{WEIGHTS[p] * 100.0}::DOUBLE')} AS points FROM props" for p in RANGES))
def score_components(spark, sf):
    out = ranking.score_components(properties(views.sites(spark, sf)))
    return out.select("site_id", "property", r("sub_score"), r("points"))


def band_sql(bands) -> str:
    whens = " ".join(f"WHEN landing_score < {b} THEN '{l}'" for b, l in bands[:-1])
    return f"CASE {whens} WHEN landing_score IS NOT NULL THEN '{bands[-1][1]}' END"


@query("score_band_ui", f"WITH {SCORED_SQL} SELECT site_id, " + band_sql(
    ((30, "Poor"), (50, "Fair"), (70, "Good"), (0, "Excellent"))) + " AS band FROM scored")
def score_band_ui(spark, sf):
    return scored(views.sites(spark, sf)).select("site_id", scoring.band_ui(F.col("landing_score")).alias("band"))


@query("score_band_doc", f"WITH {SCORED_SQL} SELECT site_id, " + band_sql(
    ((30, "Very poor"), (50, "Poor"), (70, "Fair"), (90, "Good"), (0, "Excellent"))) + " AS band FROM scored")
def score_band_doc(spark, sf):
    return scored(views.sites(spark, sf)).select("site_id", scoring.band_doc(F.col("landing_score")).alias("band"))


@query("latlon_to_pixel", f"""WITH {SITES}
SELECT site_id, CAST(floor((lon + 180E0)/360E0*1024E0) AS BIGINT) AS x, CAST(floor((90E0 - lat)/180E0*512E0) AS BIGINT) AS y FROM sites""")
def latlon_to_pixel(spark, sf):
    return views.sites(spark, sf).select("site_id", pixel_x(F.col("lon"), F.lit(1024)).alias("x"),
                                         pixel_y(F.col("lat"), F.lit(512)).alias("y"))


def uniform_sql(tag: str) -> str:
    return f"CAST(('0x' || substr(md5('7{tag}:' || CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT)/4294967296E0"


SPHERE = f"""
hashed AS (SELECT o_orderkey AS point_id, {uniform_sql('r')}*25E0 + 25E0 AS radius,
                  {uniform_sql('u')}*{2 * math.pi!r}::DOUBLE AS theta, {uniform_sql('v')}*2E0 - 1E0 AS c FROM orders),
sphere AS (SELECT point_id, radius, radius*sqrt(1E0 - c*c)*cos(theta) AS x, radius*sqrt(1E0 - c*c)*sin(theta) AS y,
                  radius*c AS z FROM hashed)"""


def sphere(spark, sf):
    """One random point per order key."""
    keys = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("point_id"))
    return keys.select("point_id", *(c.alias(n) for n, c in sphere_point(7, F.col("point_id")).items()))


@query("random_sphere_points", f"WITH {SPHERE} SELECT point_id, {rs('x')} AS x, {rs('y')} AS y, {rs('z')} AS z, {rs('radius')} AS radius FROM sphere")
def random_sphere_points(spark, sf):
    return sphere(spark, sf).select("point_id", r("x"), r("y"), r("z"), r("radius"))


@query("xyz_to_latlon", f"WITH {SPHERE} SELECT point_id, {rs('degrees(asin(y/radius))')} AS lat, {rs('degrees(atan2(z, x))')} AS lon FROM sphere")
def xyz_to_latlon(spark, sf):
    lat, lon = latlon_of(F.col("x"), F.col("y"), F.col("z"), F.col("radius"))
    return sphere(spark, sf).select("point_id", r(lat).alias("lat"), r(lon).alias("lon"))


@query("layer_key", f"""WITH {SAMPLED}, {CATALOG}
SELECT name, layer AS field, count(*) AS n, count(value) AS found FROM sampled JOIN catalog USING (layer) GROUP BY ALL""")
def layer_key_query(spark, sf):
    wide = raster.coregister(views.points(spark, sf), views.layers(spark, sf))
    named = raster.attach_metadata(raster.as_long(wide), readers.layer_catalog(spark))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("found")).select(
        "name", layer_key(F.col("name")).alias("field"), "n", "found")


@query("layers_long_to_wide", f"WITH {WIDE} SELECT * FROM wide")
def layers_long_to_wide(spark, sf):
    wide = raster.coregister(views.points(spark, sf), views.layers(spark, sf))
    named = raster.attach_metadata(raster.as_long(wide), readers.layer_catalog(spark))
    return doubles(raster.long_to_wide(named))


@query("format_report", f"WITH {WIDE} SELECT site_id, " + " || '; ' || ".join(
    f"'{n}: ' || CASE WHEN \"{k}\" IS NULL THEN 'N/A' ELSE printf('%.2f', \"{k}\") || ' {u}' END"
    for k, n, _, u, _ in LAYERS) + " AS report FROM wide")
def format_report(spark, sf):
    return raster.report(raster.coregister(views.points(spark, sf), views.layers(spark, sf)))


@query("percent_round", f"""WITH {PREDICTED}, a AS (SELECT avg(y) AS a FROM pred)
SELECT {rs('(1E0 - sum((y-p2)*(y-p2))/sum((y-a)*(y-a)))*100E0', 3)} AS r2_percent FROM pred, a""")
def percent_round_query(spark, sf):
    return predicted(spark, sf).agg(percent_round(metrics.r2("y", "p2")).alias("r2_percent"))
