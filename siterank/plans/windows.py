"""Queries over row order: rolling terrain features, indices, splits, ranks, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.constants import EARLY_STOP
from siterank.operators import ranking, splitting, tuning
from siterank.operators.ordering import over_rows
from siterank.operators.terrain import diff2_abs, diff_abs, rolling_mean, rolling_range, terrain_features
from siterank.plans.registry import SAMPLES, SCORED_SQL, STEPS, TRANSECT, TRIALS, query, r, rs, scored
from siterank.sources import views

FRAME = "OVER (PARTITION BY region ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
ORDERED = "OVER (PARTITION BY region ORDER BY seq)"
ROLLING = {
    "rolling_mean": f"CASE WHEN count(elevation) {FRAME} = 5 THEN avg(elevation) {FRAME} END",
    "rolling_max_diff": f"CASE WHEN count(elevation) {FRAME} = 5 THEN max(elevation) {FRAME} - min(elevation) {FRAME} END",
    "diff_abs": f"abs(elevation - lag(elevation) {ORDERED})",
    "diff2_abs": f"abs(elevation - lag(elevation) {ORDERED}*2E0 + lag(elevation, 2) {ORDERED})",
}


def _track(spark, sf, name, column, before, after):
    out = over_rows(views.transect(spark, sf), ["region"], "seq", before, after, {name: column})
    return out.select("region", "seq", r(name))


def _track_sql(name) -> str:
    return f"WITH {TRANSECT} SELECT region, seq, {rs(ROLLING[name])} AS {name} FROM transect"


@query("rolling_mean", _track_sql("rolling_mean"))
def rolling_mean_query(spark, sf):
    return _track(spark, sf, "rolling_mean", rolling_mean("elevation"), 2, 2)


@query("rolling_range", f"WITH {TRANSECT} SELECT region, seq, {rs(ROLLING['rolling_max_diff'])} AS rolling_range FROM transect")
def rolling_range_query(spark, sf):
    return _track(spark, sf, "rolling_range", rolling_range("elevation"), 2, 2)


@query("diff_abs", _track_sql("diff_abs"))
def diff_abs_query(spark, sf):
    return _track(spark, sf, "diff_abs", diff_abs("elevation"), 1, 0)


@query("diff2_abs", _track_sql("diff2_abs"))
def diff2_abs_query(spark, sf):
    return _track(spark, sf, "diff2_abs", diff2_abs("elevation"), 2, 0)


@query("terrain_features", f"WITH {TRANSECT} SELECT region, seq, " + ", ".join(
    f"{rs(e)} AS elevation_{n}" for n, e in ROLLING.items()) + " FROM transect")
def terrain_features_query(spark, sf):
    """All four features at once, as the slope table needs them."""
    out = terrain_features(views.transect(spark, sf))
    return out.select("region", "seq", *(r(f"elevation_{n}") for n in ROLLING))


@query("reindex", f"""WITH {SAMPLES}
SELECT site_id, row_number() OVER (ORDER BY site_id) - 1 AS seq FROM samples WHERE y_temp IS NOT NULL""")
def reindex(spark, sf):
    rows = views.samples(spark, sf).filter("y_temp is not null").select("site_id")
    return splitting.reindex(rows, ["site_id"])


@query("tail_validation_split", f"""WITH {SAMPLES},
s AS (SELECT site_id, row_number() OVER (ORDER BY site_id) - 1 AS place, count(*) OVER () AS n FROM samples WHERE y_temp IS NOT NULL)
SELECT site_id, place >= floor(n*(1E0 - 0.2E0)) AS is_validation FROM s""")
def tail_validation_split(spark, sf):
    rows = views.samples(spark, sf).filter("y_temp is not null").select("site_id")
    return splitting.tail_split(rows, ["site_id"], 0.2)


def early_stop_sql(patience: int, delta: float) -> str:
    better = f"s.val_loss + {delta}::DOUBLE < w.best"
    return f"""WITH RECURSIVE {STEPS},
walk AS (
  SELECT trial_id, step, val_loss AS best, step AS place, CAST(NULL AS BIGINT) AS stop FROM steps WHERE step = 0
  UNION ALL
  SELECT w.trial_id, s.step, CASE WHEN {better} THEN s.val_loss ELSE w.best END,
         CASE WHEN {better} THEN s.step ELSE w.place END,
         CASE WHEN NOT ({better}) AND s.step - w.place >= {patience} THEN s.step END
  FROM walk w JOIN steps s ON s.trial_id = w.trial_id AND s.step = w.step + 1 WHERE w.stop IS NULL)
SELECT trial_id, arg_max(place, step) AS best_step, max(stop) AS stop_step FROM walk GROUP BY trial_id"""


@query("early_stop", early_stop_sql(*EARLY_STOP["surface_temp"]))
def early_stop(spark, sf):
    return tuning.early_stop(views.trial_steps(spark, sf), *EARLY_STOP["surface_temp"])


@query("early_stop_chunked", early_stop_sql(*EARLY_STOP["surface_temp"]))
def early_stop_chunked(spark, sf):
    """The plan for curves too long for one row."""
    return tuning.early_stop(views.trial_steps(spark, sf), *EARLY_STOP["surface_temp"], fold_epochs=14, chunk=8)


@query("best_epoch", f"""WITH {STEPS}
SELECT trial_id, arg_min(step, (val_loss, step)) AS best_step, min(val_loss) AS score FROM steps GROUP BY trial_id""")
def best_epoch(spark, sf):
    return tuning.best_epoch(views.trial_steps(spark, sf))


@query("trial_duration", f"""WITH {TRIALS}
SELECT model, trial_id, CAST(epoch(lead(started) OVER (PARTITION BY model ORDER BY started, trial_id)) - epoch(started) AS BIGINT) AS seconds
FROM trials""")
def trial_duration(spark, sf):
    return tuning.trial_duration(views.trials(spark, sf))


@query("rank_sites", f"""WITH {SCORED_SQL}
SELECT site_id, region, landing_score,
       row_number() OVER (PARTITION BY region ORDER BY landing_score DESC NULLS LAST, site_id) AS site_rank FROM scored""")
def rank_sites(spark, sf):
    rows = scored(views.sites(spark, sf)).select("site_id", "region", "landing_score")
    return ranking.rank_sites(rows, ["region"])


CELL = "CAST(floor((lat + 90E0)/30E0) AS BIGINT) AS lat_cell, CAST(floor((lon + 180E0)/30E0) AS BIGINT) AS lon_cell"


@query("rank_sites_shared", f"""WITH {SCORED_SQL}, c AS (SELECT site_id, landing_score, {CELL} FROM scored)
SELECT *, rank() OVER w AS score_rank, dense_rank() OVER w AS score_dense_rank FROM c
WINDOW w AS (PARTITION BY lat_cell, lon_cell ORDER BY landing_score DESC NULLS LAST)""")
def rank_sites_shared(spark, sf):
    """Ranks shared by equal scores, per 30 degree cell."""
    rows = scored(views.sites(spark, sf)).select(
        "site_id", "landing_score", F.floor((F.col("lat") + 90.0) / 30.0).alias("lat_cell"),
        F.floor((F.col("lon") + 180.0) / 30.0).alias("lon_cell"))
    return ranking.rank_scores(rows, ["lat_cell", "lon_cell"])


@query("seeded_shuffle", f"""WITH {SAMPLES},
h AS (SELECT site_id, CAST(('0x' || substr(md5('42:' || CAST(site_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h FROM samples)
SELECT site_id, row_number() OVER (ORDER BY h, site_id) - 1 AS seq FROM h""")
def seeded_shuffle(spark, sf):
    return splitting.seeded_shuffle(views.samples(spark, sf).select("site_id"), "site_id")


@query("best_hyperparameters", f"""WITH {TRIALS}
SELECT model, score, trial_id, layers, units, activation FROM trials
QUALIFY row_number() OVER (PARTITION BY model ORDER BY score, trial_id) = 1""")
def best_hyperparameters(spark, sf):
    return tuning.best_trials(views.trials(spark, sf), ["layers", "units", "activation"])


@query("rung_promotion", f"""WITH {TRIALS},
p AS (SELECT *, row_number() OVER (PARTITION BY model, bracket, round ORDER BY score, trial_id) AS place FROM trials),
sizes AS (SELECT * FROM (VALUES (2, 0, 4), (2, 1, 2), (1, 0, 2)) AS s(bracket, round, next_size))
SELECT model, trial_id, bracket, round, place, place <= coalesce(next_size, 0) AS promoted
FROM p LEFT JOIN sizes USING (bracket, round)""")
def rung_promotion(spark, sf):
    out = tuning.rung_promotion(views.trials(spark, sf))
    return out.select("model", "trial_id", "bracket", "round", "place", "promoted")


@query("top_sites", f"""WITH {SCORED_SQL}
SELECT site_id, region, landing_score FROM scored ORDER BY landing_score DESC NULLS LAST, site_id LIMIT 10""")
def top_sites(spark, sf):
    return ranking.top_sites(scored(views.sites(spark, sf)).select("site_id", "region", "landing_score"), 10)


@query("train_test_split", f"""WITH {SAMPLES}
SELECT site_id, CAST(('0x' || substr(md5('42:' || CAST(site_id AS VARCHAR)), 1, 8)) AS BIGINT)/4294967296E0 < 0.2E0 AS test
FROM samples""")
def train_test_split(spark, sf):
    train, test = splitting.train_test_split(views.samples(spark, sf).select("site_id"), ["site_id"])
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


@query("kfold", f"""WITH {SAMPLES}
SELECT site_id, CAST(('0x' || substr(md5('42:' || CAST(site_id AS VARCHAR)), 1, 8)) AS BIGINT)%3 AS fold3,
       CAST(('0x' || substr(md5('42:' || CAST(site_id AS VARCHAR)), 1, 8)) AS BIGINT)%5 AS fold5 FROM samples""")
def kfold(spark, sf):
    key = F.col("site_id")
    return views.samples(spark, sf).select("site_id", splitting.fold(42, 3, key).cast("long").alias("fold3"),
                                           splitting.fold(42, 5, key).cast("long").alias("fold5"))
