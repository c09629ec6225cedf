"""Queries over projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.constants import DEFAULTS, FEATURES, FEATURES_FULL, PROPERTIES
from siterank.functions.features import feature_vector, feature_vector_by_name
from siterank.functions.geometry import inside, pixel_x, pixel_y
from siterank.functions.numbers import coerce_numeric
from siterank.functions.scoring import clamp
from siterank.operators import clean
from siterank.operators.raster import layer_sizes
from siterank.plans.registry import POINTS, RASTER, SAMPLES, SITES, TRANSECT, feature_sql, query, r, rs
from siterank.sources import readers, views

TEMP_FEATURES = ("elevation", "albedo", "temperature", "slope", "roughness")
XY = ", ".join(rs(c) + f' AS "{c}"' for c in (*TEMP_FEATURES, "y_temp"))


@query("select_xy", f"WITH {SAMPLES} SELECT site_id, {XY} FROM samples")
def select_xy(spark, sf):
    out = clean.select_xy(views.samples(spark, sf), TEMP_FEATURES, "y_temp", ["site_id"])
    return out.select("site_id", *(r(c) for c in (*TEMP_FEATURES, "y_temp")))


@query("select_positional", f"""WITH {SAMPLES}
SELECT site_id, {rs('"tempRange"')} AS x0, {rs('albedo')} AS x1, {rs('slope')} AS x2, {rs('ferric')} AS x3,
       {rs('y_inertia')} AS y FROM samples""")
def select_positional(spark, sf):
    data = views.samples(spark, sf).select("site_id", "tempRange", "albedo", "slope", "ferric", "y_inertia")
    inputs, target = clean.select_positional(data.drop("site_id"))
    return data.select("site_id", *(r(F.col(c)).alias(f"x{i}") for i, c in enumerate(inputs)),
                       r(F.col(target)).alias("y"))


@query("drop_columns", f"WITH {TRANSECT} SELECT region, seq FROM transect")
def drop_columns(spark, sf):
    return views.transect(spark, sf).drop("elevation", "event_id")


FILLED = ", ".join(rs(f'coalesce("{c}", {d}::DOUBLE)') + f' AS "{c}"' for c, d in DEFAULTS.items())
MISSING = " + ".join(f'("{c}" IS NULL)::BIGINT' for c in DEFAULTS)


@query("default_fill", f"WITH {SITES} SELECT site_id, {FILLED}, {MISSING} AS n_defaulted FROM sites")
def default_fill(spark, sf):
    out = clean.default_fill(views.sites(spark, sf))
    return out.select("site_id", *(r(c) for c in DEFAULTS), "n_defaulted")


ZERO = ("elevation", "slope", "roughness", "albedo", "pyroxene", "lambertAlbedo")
ZERO_SQL = ", ".join(rs(f'coalesce("{c}", 0E0)') + f' AS "{c}"' for c in ZERO)


@query("default_fill_zero", f"WITH {SITES} SELECT site_id, {ZERO_SQL} FROM sites")
def default_fill_zero(spark, sf):
    return clean.default_fill(views.sites(spark, sf), zero=True).select("site_id", *(r(c) for c in ZERO))


def vectors(df, models, **kw):
    """(site_id, model, f1..f8) for each model's vector."""
    rows = F.array(*(F.struct(F.lit(m).alias("model"), feature_vector(m, **kw).alias("x")) for m in models))
    wide = df.select("site_id", F.inline(rows))
    return wide.select("site_id", "model", *(r(F.get("x", F.lit(i)), 9).alias(f"f{i + 1}") for i in range(8)))


def vectors_sql(models, scaled, sets) -> str:
    parts = []
    for m in models:
        e = feature_sql(m, scaled, sets) if m in sets else ["0E0"] * 8
        cols = ", ".join((rs(e[i], 9) if i < len(e) else "CAST(NULL AS DOUBLE)") + f" AS f{i + 1}" for i in range(8))
        parts.append(f"SELECT site_id, '{m}' AS model, {cols} FROM filled")
    return " UNION ALL ".join(parts)


SERVING = SITES + ", filled AS (SELECT * REPLACE (" + ", ".join(
    f'coalesce("{c}", {d}::DOUBLE) AS "{c}"' for c, d in DEFAULTS.items()) + ") FROM sites)"
ZEROS = SITES + ", filled AS (SELECT * REPLACE (" + ", ".join(
    f'coalesce("{c}", 0E0) AS "{c}"' for c in ("elevation", "slope", "roughness", "albedo", "temperature", "tempRange",
                                              "crustalThickness", "ferric", "pyroxene", "basalt", "lambertAlbedo")
) + ") FROM sites)"


@query("assemble_features", f"WITH {SERVING} {vectors_sql(PROPERTIES, False, FEATURES)}")
def assemble_features(spark, sf):
    return vectors(clean.default_fill(views.sites(spark, sf)), PROPERTIES)


@query("assemble_features_full", f"WITH {ZEROS} {vectors_sql((*PROPERTIES, 'other'), False, FEATURES_FULL)}")
def assemble_features_full(spark, sf):
    return vectors(clean.default_fill(views.sites(spark, sf), zero=True), (*PROPERTIES, "other"), full=True)


@query("static_scale", f"WITH {SERVING} {vectors_sql(PROPERTIES, True, FEATURES)}")
def static_scale(spark, sf):
    return vectors(clean.default_fill(views.sites(spark, sf)), PROPERTIES, scaled=True)


@query("static_scale_full", f"WITH {ZEROS} {vectors_sql(PROPERTIES, True, FEATURES_FULL)}")
def static_scale_full(spark, sf):
    return vectors(clean.default_fill(views.sites(spark, sf), zero=True), PROPERTIES, scaled=True, full=True)


@query("clamp_predictions", f"""WITH {SITES},
p AS (SELECT site_id, CASE WHEN region = 'BUILDING' THEN 'NaN'::DOUBLE ELSE elevation/1000E0 END AS slope,
             albedo*7E0 - 0.9E0 AS dust, elevation/10E0 AS surface_temp,
             CASE WHEN region = 'MACHINERY' THEN 'NaN'::DOUBLE ELSE elevation/10E0 END AS thermal_inertia,
             pyroxene*120E0 - 1E0 AS water FROM sites)
SELECT site_id,
       {rs('CASE WHEN isnan(slope) THEN 0E0 WHEN slope IS NOT NULL THEN greatest(0E0, slope) END')} AS slope,
       {rs('CASE WHEN dust IS NOT NULL THEN least(1E0, greatest(0E0, dust)) END')} AS dust,
       {rs('surface_temp')} AS surface_temp,
       {rs('CASE WHEN isnan(thermal_inertia) THEN 0E0 WHEN thermal_inertia IS NOT NULL THEN greatest(0E0, thermal_inertia) END')} AS thermal_inertia,
       {rs('CASE WHEN water IS NOT NULL THEN least(8E0, greatest(0E0, water)) END')} AS water FROM p""")
def clamp_predictions(spark, sf):
    nan = F.lit(float("nan"))
    raw = {
        "slope": F.when(F.col("region") == "BUILDING", nan).otherwise(F.col("elevation") / 1000.0),
        "dust": F.col("albedo") * 7.0 - 0.9,
        "surface_temp": F.col("elevation") / 10.0,
        "thermal_inertia": F.when(F.col("region") == "MACHINERY", nan).otherwise(F.col("elevation") / 10.0),
        "water": F.col("pyroxene") * 120.0 - 1.0,
    }
    return views.sites(spark, sf).select("site_id", *(r(c).alias(p) for p, c in clamp(raw).items()))


NOT_NULL = " AND ".join(f'"{c}" IS NOT NULL' for c in TEMP_FEATURES)


@query("drop_null_rows", f"WITH {SAMPLES} SELECT site_id, {XY} FROM samples WHERE {NOT_NULL} AND y_temp IS NOT NULL")
def drop_null_rows(spark, sf):
    out = views.samples(spark, sf).select("site_id", *TEMP_FEATURES, "y_temp").na.drop("any")
    return out.select("site_id", *(r(c) for c in (*TEMP_FEATURES, "y_temp")))


@query("drop_null_subset", f"""WITH {SAMPLES}
SELECT site_id, {rs('elevation')} AS elevation, {rs('slope')} AS slope FROM samples WHERE y_dust IS NOT NULL AND albedo IS NOT NULL""")
def drop_null_subset(spark, sf):
    return views.samples(spark, sf).na.drop(subset=["y_dust", "albedo"]).select("site_id", r("elevation"), r("slope"))


@query("coerce_numeric", """
SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey%2 = 1 THEN c_name ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS number
FROM customer""")
def coerce(spark, sf):
    return views.mixed_numbers(spark, sf).select("c_custkey", coerce_numeric(F.col("raw")).alias("number"))


@query("bounds_filter", f"""WITH {POINTS}, {RASTER},
s AS (SELECT max(width) AS w, max(height) AS h FROM raster WHERE layer = 'elevation'),
p AS (SELECT site_id, CAST(floor((lon + 180E0)/360E0*w) AS BIGINT) AS x,
             CAST(floor((90E0 - lat)/180E0*h) AS BIGINT) AS y, w, h FROM points, s)
SELECT site_id, x, y, coalesce(x >= 0 AND x < w AND y >= 0 AND y < h, false) AS inside FROM p""")
def bounds_filter(spark, sf):
    size = layer_sizes(views.layers(spark, sf)).filter(F.col("layer") == "elevation").first()
    w, h = F.lit(size.width), F.lit(size.height)
    x, y = pixel_x(F.col("lon"), w), pixel_y(F.col("lat"), h)
    return views.points(spark, sf).select("site_id", x.alias("x"), y.alias("y"), inside(x, y, w, h).alias("inside"))


@query("route_invalid", """
SELECT o_orderkey AS request_id, 'site' AS source, 200 AS status, CAST(NULL AS VARCHAR) AS error
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT event_id, 'event', CASE WHEN json_valid(props) THEN 200 ELSE 400 END,
                 CASE WHEN NOT json_valid(props) THEN 'Request must be JSON' END FROM events
UNION ALL SELECT doc_id, 'document', CASE WHEN json_valid(text) THEN 200 ELSE 400 END,
                 CASE WHEN NOT json_valid(text) THEN 'Request must be JSON' END FROM documents""")
def route_invalid(spark, sf):
    routed = clean.route(readers.decode_requests(views.requests(spark, sf)))
    return routed.select("request_id", "source", "status", "error")


AUDITED = ("elevation", "slope", "roughness", "albedo", "temperature", "pyroxene", "region")


@query("null_audit", f"WITH {SITES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls, count(*) AS n_rows, "
    f"{len(AUDITED)} AS n_columns FROM sites" for c in AUDITED))
def null_audit(spark, sf):
    return clean.null_audit(views.sites(spark, sf), AUDITED)


@query("nonfinite_audit", f"""WITH {SAMPLES},
t AS (SELECT CASE WHEN region = 'BUILDING' THEN 'NaN'::DOUBLE ELSE y_temp END AS a,
             CASE WHEN region = 'NOWHERE' THEN 'Infinity'::DOUBLE ELSE y_slope END AS b FROM samples)
SELECT coalesce(bool_or(isnan(a) OR isnan(b)), false) AS any_nan, coalesce(bool_or(isinf(a) OR isinf(b)), false) AS any_inf FROM t""")
def nonfinite_audit(spark, sf):
    rows = views.samples(spark, sf).select(
        F.when(F.col("region") == "BUILDING", float("nan")).otherwise(F.col("y_temp")).alias("a"),
        F.when(F.col("region") == "NOWHERE", float("inf")).otherwise(F.col("y_slope")).alias("b"))
    return clean.nonfinite_audit(rows, ["a", "b"])


NAMED = {"AUTOMOBILE": "slope", "BUILDING": "dust", "FURNITURE": "thermal_inertia", "MACHINERY": "water"}
NAME_SQL = "CASE region " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMED.items()) + " ELSE 'gravity' END"
FIRST_SQL = "CASE m " + " ".join(
    f"WHEN '{m}' THEN {feature_sql(m, False)[0]}" for m in NAMED.values()) + " ELSE 0E0 END"
WIDTH_SQL = "CASE m " + " ".join(f"WHEN '{m}' THEN {len(FEATURES[m])}" for m in NAMED.values()) + " ELSE 8 END"


@query("reject_unknown_model", f"""WITH {SERVING},
named AS (SELECT *, {NAME_SQL} AS m FROM filled)
SELECT site_id, m AS model, {WIDTH_SQL} AS width, {rs(FIRST_SQL)} AS first FROM named""")
def reject_unknown_model(spark, sf):
    name = F.coalesce(*(F.when(F.col("region") == k, v) for k, v in NAMED.items()), F.lit("gravity"))
    rows = clean.default_fill(views.sites(spark, sf)).withColumn("model", name)
    x = feature_vector_by_name(F.col("model"), strict=False)
    return rows.select("site_id", "model", F.size(x).cast("long").alias("width"), r(F.get(x, F.lit(0))).alias("first"))


@query("fallback_predictions", f"""WITH {SAMPLES}
SELECT site_id, {rs('coalesce(y_slope, 0E0)')} AS nn_slope, {rs('coalesce(y_temp, -44.8E0)')} AS xgb_temp,
       {rs('coalesce(y_inertia, 445.2E0)')} AS xgb_inertia,
       CASE WHEN y_slope IS NULL THEN 'fallback' ELSE 'model' END AS nn_slope_source,
       CASE WHEN y_temp IS NULL THEN 'fallback' ELSE 'model' END AS xgb_temp_source FROM samples""")
def fallback_predictions(spark, sf):
    rows = views.samples(spark, sf).select(
        "site_id", F.col("y_slope").alias("nn_slope"), F.col("y_temp").alias("xgb_temp"),
        F.col("y_inertia").alias("xgb_inertia"))
    out = clean.fallback_predictions(rows, {"slope": "nn_slope"},
                                     {"surface_temp": "xgb_temp", "thermal_inertia": "xgb_inertia"})
    return out.select("site_id", r("nn_slope"), r("xgb_temp"), r("xgb_inertia"), "nn_slope_source", "xgb_temp_source")
