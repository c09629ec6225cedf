"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.functions.numbers import half_up
from siterank.functions.scoring import band_ui
from siterank.functions.targets import log_target
from siterank.operators import metrics, tuning
from siterank.operators.quantiles import quantile_grid as grid
from siterank.operators.ranking import band_summary as summarise
from siterank.operators.scaling import robust_stats as stats, robust_stats_approx as stats_approx, target_min as lowest
from siterank.operators.splitting import fold
from siterank.plans.registry import SAMPLES, SCORED_SQL, SITES, TRIALS, query, r, rs, scored
from siterank.sources import views

FEATURES = ("elevation", "albedo", "roughness", "tempRange", "ferric")
UNPIVOTED = " UNION ALL ".join(f"SELECT '{c}' AS feature, \"{c}\" AS v, region FROM sites" for c in FEATURES)
# Fit and compare: a fixed rule standing for two models' predictions of y_temp.
PREDICTED = SAMPLES + """,
pred AS (SELECT site_id, y_temp AS y, -40.0E0 - elevation/400.0E0 AS p1, y_temp*0.9E0 - 1.0E0 AS p2,
                CAST(('0x' || substr(md5('42:' || CAST(site_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS fold
         FROM samples WHERE y_temp IS NOT NULL)"""


def predicted(spark, sf):
    return views.samples(spark, sf).filter("y_temp is not null").select(
        "site_id", F.col("y_temp").alias("y"), (F.lit(-40.0) - F.col("elevation") / 400.0).alias("p1"),
        (F.col("y_temp") * 0.9 - 1.0).alias("p2"), fold(42, 3, F.col("site_id")).alias("fold"))


@query("target_min", f"WITH {SAMPLES} SELECT {rs('min(y_temp)')} AS y_min FROM samples")
def target_min(spark, sf):
    return lowest(views.samples(spark, sf), "y_temp").select(r("y_min"))


@query("robust_stats", f"""WITH {SITES}, f AS ({UNPIVOTED}),
q AS (SELECT feature, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM f GROUP BY 1)
SELECT feature, {rs('m')} AS center, {rs('CASE WHEN iqr = 0 THEN 1E0 ELSE iqr END')} AS scale FROM q""")
def robust_stats(spark, sf):
    return stats(views.sites(spark, sf), FEATURES).select("feature", r("center"), r("scale"))


@query("robust_stats_approx", f"""WITH {SITES}, f AS ({UNPIVOTED})
SELECT feature, count(v) AS n, true AS within FROM f GROUP BY feature""")
def robust_stats_approx(spark, sf):
    """Whether the sketch's median is within its rank error (one in 10,000 rows) of the exact place."""
    sites = views.sites(spark, sf)
    sketch = stats_approx(sites, FEATURES)
    long = sites.unpivot([], [F.col(c).cast("double").alias(c) for c in FEATURES], "feature", "v").where("v is not null")
    placed = long.join(F.broadcast(sketch), "feature").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("center")).alias("_below"), F.count_if(F.col("v") <= F.col("center")).alias("_upto"))
    error = F.col("n") / 10_000 + 1
    return placed.select("feature", "n", ((F.col("_below") <= F.col("n") / 2 + error) & (F.col("_upto") >= F.col("n") / 2 - error)).alias("within"))


GRID_SQL = f"""WITH {SITES}, f AS ({UNPIVOTED}),
q AS (SELECT feature, quantile_cont(v, [{', '.join(str(i / 99) for i in range(100))}]) AS g FROM f GROUP BY 1)
SELECT feature, i, {rs('i/99E0')} AS p, {rs('g[i+1]')} AS value FROM q, unnest(range(100)) AS n(i)"""


@query("quantile_grid", GRID_SQL)
def quantile_grid(spark, sf):
    return grid(views.sites(spark, sf), FEATURES, 100).select("feature", "i", r("p"), r("value"))


@query("quantile_grid_sorted", GRID_SQL)
def quantile_grid_sorted(spark, sf):
    """The plan for tables too large for the built-in percentile."""
    return grid(views.sites(spark, sf), FEATURES, 100, limit=0).select("feature", "i", r("p"), r("value"))


@query("r2", f"""WITH {PREDICTED}
SELECT {rs('1E0 - sum((y-p1)*(y-p1))/sum((y-a)*(y-a))')} AS r2
FROM pred, (SELECT avg(y) AS a FROM pred)""")
def r2(spark, sf):
    return predicted(spark, sf).agg(half_up(metrics.r2("y", "p1"), 6).alias("r2"))


@query("mae", f"WITH {PREDICTED} SELECT {rs('avg(abs(y-p1))')} AS mae FROM pred")
def mae(spark, sf):
    return predicted(spark, sf).agg(half_up(metrics.mae("y", "p1"), 6).alias("mae"))


@query("mse", f"WITH {PREDICTED} SELECT {rs('avg((y-p1)*(y-p1))')} AS mse FROM pred")
def mse(spark, sf):
    return predicted(spark, sf).agg(half_up(metrics.mse("y", "p1"), 6).alias("mse"))


def histogram_sql(value: str, bins: int) -> str:
    return f"""WITH {SAMPLES}, v AS (SELECT {value} AS v FROM samples WHERE y_slope IS NOT NULL),
m AS (SELECT min(v) AS lo, (max(v) - min(v))/{bins} AS w FROM v),
c AS (SELECT least(CAST(floor((v - lo)/w) AS BIGINT), {bins - 1}) AS bin, count(*) AS n FROM v, m GROUP BY 1)
SELECT b.bin, {rs('lo + b.bin*w')} AS low, {rs('lo + (b.bin+1)*w')} AS high, coalesce(n, 0) AS n
FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN m LEFT JOIN c ON c.bin = b.bin"""


@query("histogram", histogram_sql("ln(1E0 + y_slope)", 50))
def histogram(spark, sf):
    rows = views.samples(spark, sf).select(log_target(F.col("y_slope")).alias("v"))
    return metrics.histogram(rows, "v", 50).select("bin", r("low"), r("high"), "n")


@query("histogram_inertia", histogram_sql("y_inertia", 10))
def histogram_inertia(spark, sf):
    return metrics.histogram(views.samples(spark, sf), "y_inertia", 10).select("bin", r("low"), r("high"), "n")


@query("prediction_extent", f"""WITH {PREDICTED}
SELECT {rs('least(min(y), min(p1), min(p2))')} AS min_val, {rs('greatest(max(y), max(p1), max(p2))')} AS max_val FROM pred""")
def prediction_extent(spark, sf):
    return metrics.extent(predicted(spark, sf), ["y", "p1", "p2"]).select(r("min_val"), r("max_val"))


@query("model_comparison", f"""WITH {PREDICTED},
long AS (SELECT 'first' AS model, y, p1 AS p FROM pred UNION ALL SELECT 'second', y, p2 FROM pred),
a AS (SELECT model, avg(y) AS a FROM long GROUP BY 1)
SELECT model, count(*) AS n, {rs('(1E0 - sum((y-p)*(y-p))/sum((y-a)*(y-a)))*100E0', 3)} AS r2_percent,
       {rs('avg(abs(y-p))')} AS mae
FROM long JOIN a USING (model) GROUP BY model""")
def model_comparison(spark, sf):
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), F.col(p).alias("p")) for m, p in (("first", "p1"), ("second", "p2"))))
    long = predicted(spark, sf).select("y", F.inline(pairs))
    return metrics.model_comparison(long).withColumn("mae", r("mae"))


@query("cv_score", f"""WITH {PREDICTED},
long AS (SELECT 1 AS candidate, fold, y, p1 AS p FROM pred UNION ALL SELECT 2, fold, y, p2 FROM pred),
a AS (SELECT candidate, fold, avg(y) AS a FROM long GROUP BY ALL),
s AS (SELECT candidate, fold, 1E0 - sum((y-p)*(y-p))/sum((y-a)*(y-a)) AS r2 FROM long JOIN a USING (candidate, fold) GROUP BY ALL)
SELECT CAST(candidate AS BIGINT) AS candidate, {rs('avg(r2)')} AS mean_r2, count(*) AS folds FROM s GROUP BY candidate""")
def cv_score(spark, sf):
    pairs = F.array(*(F.struct(F.lit(i).cast("long").alias("candidate"), F.col(f"p{i}").alias("p")) for i in (1, 2)))
    long = predicted(spark, sf).select("fold", "y", F.inline(pairs))
    return metrics.cv_score(long).select("candidate", r("mean_r2"), "folds")


@query("rung_summary", f"""WITH {TRIALS}
SELECT model, bracket, round, count(*) AS trials, min(score) AS best_score, {rs('avg(score)', 4)} AS mean_score
FROM trials GROUP BY ALL""")
def rung_summary(spark, sf):
    return tuning.rung_summary(views.trials(spark, sf)).withColumn("mean_score", r("mean_score", 4))


@query("hyperparameter_marginals", f"""WITH {TRIALS},
u AS (SELECT 'layers' AS name, CAST(layers AS VARCHAR) AS setting, score FROM trials
      UNION ALL SELECT 'units', CAST(units AS VARCHAR), score FROM trials
      UNION ALL SELECT 'activation', activation, score FROM trials)
SELECT name, setting, count(*) AS trials, min(score) AS best_score, {rs('avg(score)', 4)} AS mean_score FROM u GROUP BY ALL""")
def hyperparameter_marginals(spark, sf):
    out = tuning.marginals(views.trials(spark, sf), ["layers", "units", "activation"])
    return out.withColumn("mean_score", r("mean_score", 4))


@query("dedupe_trials", f"""WITH {TRIALS}
SELECT model, md5('activation=' || activation || '|layers=' || layers || '|units=' || units) AS fingerprint,
       min(trial_id) AS trial_id, count(*) AS tried FROM trials GROUP BY ALL""")
def dedupe_trials(spark, sf):
    return tuning.dedupe(views.trials(spark, sf), ["layers", "units", "activation"])


@query("band_summary", f"""WITH {SCORED_SQL},
b AS (SELECT region, landing_score, CASE WHEN landing_score < 30 THEN 'Poor' WHEN landing_score < 50 THEN 'Fair'
             WHEN landing_score < 70 THEN 'Good' WHEN landing_score IS NOT NULL THEN 'Excellent' END AS band FROM scored)
SELECT region, band, count(*) AS sites, {rs('(CAST(sum(CAST(round(landing_score*100E0) AS BIGINT)) AS DOUBLE)/(count(landing_score)*100E0))', 4)} AS mean_score FROM b GROUP BY ALL""")
def band_summary(spark, sf):
    rows = scored(views.sites(spark, sf)).withColumn("band", band_ui(F.col("landing_score")))
    return summarise(rows, "band", ["region"])
