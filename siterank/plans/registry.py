"""Registered queries and the SQL each one must agree with.

The SQL is written separately from the operators, against the raw tables. Doubles are
rounded half up by floor on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siterank.constants import FEATURES, LAYER_KEYS, RANGES, WEIGHTS
from siterank.functions.numbers import half_up
from siterank.functions.scoring import site_score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded column under its own name, for comparison."""
    if isinstance(c, str):
        return half_up(F.col(c), digits).alias(c)
    return half_up(c, digits)


def rs(expr: str, digits: int = 6) -> str:
    """SQL counterpart of ``r``."""
    return f"floor(({expr})*1e{digits}+0.5)/1e{digits}"


# --- views in SQL --------------------------------------------------------------------

SITES = """
li AS (
  SELECT l_orderkey, count(*) AS n,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS q,
         CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE) AS ds,
         CAST(max(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE) AS dm,
         CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE) AS tx,
         CAST(max(CAST(round(l_extendedprice) AS BIGINT)) AS DOUBLE) AS pm
  FROM lineitem GROUP BY l_orderkey),
sites AS (
  SELECT o_orderkey AS site_id,
         90.0E0 - ((o_orderkey*53)%1800)/10.0E0 AS lat,
         ((o_orderkey*37)%3600)/10.0E0 - 180.0E0 AS lon,
         o_totalprice/25.0E0 - 8000.0E0 AS elevation,
         q/(n*10.0E0) AS slope,
         pm/1000.0E0 AS roughness,
         0.1E0 + ds/(n*50.0E0) AS albedo,
         -90.0E0 + (tx*10.0E0)/n AS temperature,
         20.0E0 + dm*10.0E0 AS "tempRange",
         10.0E0 + (c_custkey%700)/10.0E0 AS "crustalThickness",
         0.95E0 + tx/(n*1000.0E0) AS ferric,
         dm/100.0E0 AS pyroxene,
         c_nationkey/25.0E0 AS basalt,
         0.11E0 + ds/(n*45.0E0) AS "lambertAlbedo",
         c_mktsegment AS region
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""

SAMPLES = SITES + """,
samples AS (
  SELECT *,
         -40.0E0 - elevation/400.0E0 + albedo*60.0E0 - roughness*0.1E0 + z AS y_temp,
         0.5E0 + albedo*8.0E0 + roughness*0.01E0 + (z + 2.0E0)*0.1E0 AS y_slope,
         150.0E0 + "tempRange"*1.5E0 - albedo*200.0E0 + z*5.0E0 AS y_inertia,
         0.6E0 + albedo*0.3E0 + z*0.002E0 AS y_dust,
         2.0E0 + pyroxene*20.0E0 + "crustalThickness"*0.02E0 + z*0.2E0 AS y_water
  FROM (SELECT *, ((site_id*7919)%1000)/250.0E0 - 2.0E0 AS z FROM sites))"""

POINTS = SITES + """,
points AS (
  SELECT site_id, lat, lon FROM sites
  UNION ALL SELECT * FROM (VALUES (-1, 0.0E0, 180.0E0), (-2, -90.0E0, 0.0E0), (-3, 90.0E0, -180.0E0),
                                  (-4, NULL, 0.0E0)) AS e(site_id, lat, lon))"""

RASTER = f"""
raster AS (
  SELECT [{', '.join(f"'{k}'" for k in LAYER_KEYS)}][label+1] AS layer,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y,
         len(embedding) AS width, count(*) OVER (PARTITION BY label) AS height, embedding AS pixels
  FROM embeddings)"""

TRANSECT = """
transect AS (
  SELECT event_type AS region, event_id, value AS elevation,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq
  FROM events)"""

STEPS = """
steps AS (
  SELECT c_mktsegment AS model, c_custkey AS trial_id,
         row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step,
         o_totalprice AS val_loss, o_orderdate AS started, c_custkey%3 AS bracket,
         CAST(floor(c_custkey/3.0E0) AS BIGINT)%(c_custkey%3+1) AS round,
         1 + c_nationkey%2 AS layers, 16*(1 + c_nationkey%4) AS units,
         CASE WHEN c_nationkey < 12 THEN 'relu' ELSE 'tanh' END AS activation
  FROM customer JOIN orders ON o_custkey = c_custkey)"""

TRIALS = STEPS + """,
trials AS (
  SELECT model, trial_id, bracket, round, layers, units, activation,
         CASE WHEN round > 0 THEN trial_id - 3 END AS parent_id,
         min(val_loss) AS score, arg_min(step, (val_loss, step)) AS best_step, max(val_loss) AS worst,
         count(*) AS steps, min(started) AS started
  FROM steps GROUP BY ALL)"""


def norm_sql(value: str, low: float, high: float, invert: bool) -> str:
    share = f"greatest(0E0, least(1E0, ({value} - {low}::DOUBLE)/({high}::DOUBLE - {low}::DOUBLE)))"
    share = f"(1E0 - {share})" if invert else share
    return f"CASE WHEN ({value}) IS NOT NULL AND NOT isnan({value}) THEN {share} END"


def score_sql(weights=None, columns=None) -> str:
    weights = weights or {p: f"{w}::DOUBLE" for p, w in WEIGHTS.items()}
    columns = columns or {p: p for p in RANGES}
    total = " + ".join(f"({norm_sql(columns[p], *RANGES[p])})*({weights[p]})" for p in RANGES)
    return rs(f"({total})*100E0", 2)


# Properties taken from the measurements, for queries about scores alone.
PROPERTIES_SQL = SITES + """,
props AS (
  SELECT site_id, region, lat, lon, CASE WHEN site_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE slope END AS slope, 0.6E0 + albedo/3.0E0 AS dust,
         CASE WHEN site_id % 89 = 0 THEN 'NaN'::DOUBLE ELSE temperature END AS surface_temp,
         100.0E0 + "tempRange"*3.0E0 AS thermal_inertia, 1.0E0 + pyroxene*70.0E0 AS water
  FROM sites)"""

SCORED_SQL = PROPERTIES_SQL + f""",
scored AS (SELECT *, {score_sql()} AS landing_score FROM props)"""
# the same without a NaN
FINITE_SQL = SCORED_SQL.replace("CASE WHEN site_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE slope END AS slope", "slope").replace(
    "CASE WHEN site_id % 89 = 0 THEN 'NaN'::DOUBLE ELSE temperature END AS surface_temp", "temperature AS surface_temp")


def properties(sites: DataFrame) -> DataFrame:
    """Measurements standing for the five properties, a few of them NaN."""
    return sites.select(
        "site_id", "region", "lat", "lon", F.when(F.col("site_id") % 97 == 0, float("nan")).otherwise(F.col("slope")).alias("slope"),
        (F.lit(0.6) + F.col("albedo") / 3.0).alias("dust"),
        F.when(F.col("site_id") % 89 == 0, float("nan")).otherwise(F.col("temperature")).alias("surface_temp"),
        (F.lit(100.0) + F.col("tempRange") * 3.0).alias("thermal_inertia"),
        (F.lit(1.0) + F.col("pyroxene") * 70.0).alias("water"))


def scored(sites: DataFrame) -> DataFrame:
    props = properties(sites)
    return props.withColumn("landing_score", site_score({p: F.col(p) for p in RANGES}))


def feature_sql(model: str, scaled: bool, sets=FEATURES, latitude: str = "0E0") -> list[str]:
    """The model's inputs as SQL expressions."""
    special = {"|slope|": "abs(slope)", "|slope*0.1|": "abs(slope*0.1E0)", "latitude": latitude}
    out = []
    for token, divisor in sets[model]:
        e = special.get(token, f'"{token}"')
        out.append(f"({e})/{divisor}::DOUBLE" if scaled and divisor != 1.0 else e)
    return out
