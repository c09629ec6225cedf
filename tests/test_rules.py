"""Rules that must hold alike in every plan of an operator."""

import json
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from siterank.functions import scoring
from siterank.operators import clean, quantiles, raster, tuning
from siterank.operators.dense_net import Net, net_column
from siterank.plans.catalog import QUERIES
from siterank.sources import readers

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def scanlines(spark):
    rows = [("elevation", y, 4, 3, [float(10 * y + x) for x in range(4)]) for y in range(3)] + [("slope", 0, 2, 1, [7.0, 8.0])]
    return spark.createDataFrame(rows, "layer string, y long, width int, height int, pixels array<float>")


@pytest.mark.parametrize("few", [0, 10_000])
def test_raster_plans_agree_on_repeated_and_null_ids(spark, scanlines, few):
    points = spark.createDataFrame(
        [(1, 80.0, -170.0), (1, -80.0, 170.0), (1, 80.0, -170.0), (None, 0.0, 0.0), (None, None, 0.0), (2, -90.0, 0.0), (3, 10.0, 181.0), (4, float("nan"), 1.0)],
        "site_id long, lat double, lon double")
    want = plain(raster.coregister(points, scanlines).collect())
    assert plain(raster.coregister(points, scanlines, broadcast_bytes=0, few_points=few).collect()) == want


def test_few_points_filter_scanlines_before_any_shuffle(spark, scanlines):
    one = spark.createDataFrame([(1, 80.0, -170.0)], "site_id long, lat double, lon double")
    plan = raster.coregister(one, scanlines, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [layer" in plan


def test_raster_queries_run_the_plan_they_name(spark, sf):
    """The tiled query shuffles on (layer, y, tile); the positions query sends positions to the scanlines."""
    text = {n: QUERIES[n](spark, sf)._jdf.queryExecution().optimizedPlan().toString() for n in ("coregister_layers_tiled", "coregister_layers_positions")}
    assert "tile#" in text["coregister_layers_tiled"] and "tile#" not in text["coregister_layers_positions"]
    assert "strategy=broadcast" not in text["coregister_layers_tiled"] and "strategy=broadcast" in text["coregister_layers_positions"]


@pytest.mark.parametrize("points", [2, 7, 101])
def test_quantile_plans_are_equal_to_the_bit(spark, points):
    rows = [(k % 3, None if k % 11 == 0 else float("nan") if k % 13 == 0 else math.sin(k) * 10 ** (k % 5), float(k % 4), -0.0 if k % 2 else 0.0, None) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, a double, b double, z double, n double")
    for by in ((), ("g",)):
        one, other = ({tuple(r[c] for c in (*by, "feature", "i")): (r.p, None if r.value is None else r.value.hex()) for r in quantiles.quantile_grid(
            df, ["a", "b", "z", "n"], points, by, limit).collect() if r.value is not None} for limit in (10**9, 0))
        assert one == other and one


NAN = float("nan")
CURVES = {
    1: [NAN, 9.0, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0], 2: [None, None, 5.0, 6.0, 4.0, NAN, NAN, NAN, 3.0], 3: [NAN] * 8, 4: [5.0, 4.0, NAN, 3.0, None, 2.0, 1.0],
    5: [3.0, 2.0, 1.0, NAN], 6: [float("inf"), 2.0, 2.5, 2.5, 2.5, 2.5], 7: [1.0], 8: [9.0 - k for k in range(9)], 9: [None, 1.0],
}


def walk(curve, patience, delta):
    best, at = math.inf, -1
    for k, loss in enumerate(curve):
        if loss is not None and not math.isnan(loss) and loss + delta < best:
            best, at = loss, k
        elif k - at >= patience:
            return (None if at < 0 else at, k)
    return (None if at < 0 else at, None)


def test_early_stop_plans_agree_on_missing_losses(spark):
    steps = spark.createDataFrame([(t, k, loss) for t, c in CURVES.items() for k, loss in enumerate(c)], "trial_id long, step long, val_loss double")
    want = {t: walk(c, 3, 0.1) for t, c in CURVES.items()}
    for settings in ({}, {"fold_epochs": 2, "chunk": 3}, {"fold_epochs": 0, "chunk": 4}):
        got = {r.trial_id: (r.best_step, r.stop_step) for r in tuning.early_stop(steps, 3, 0.1, **settings).collect()}
        assert got == want


@pytest.mark.parametrize("activation", ["relu", "tanh", "elu"])
def test_net_engines_agree_on_missing_features(spark, activation):
    net = Net.random(2, [3], activation)
    rows = [(1, [0.5, 1.0]), (2, [NAN, 1.0]), (3, [None, 1.0]), (4, None), (5, [1.0]), (6, [-2.0, 0.25]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    one, other = ({r.k: r.z for r in df.select("k", net_column(net, "x", engine).alias("z")).collect()} for engine in ("expression", "batches"))
    for k in one:
        if one[k] is None or other[k] is None:
            assert one[k] == other[k] and k in (3, 4, 5)
        else:
            assert one[k] == pytest.approx(other[k], nan_ok=True) and (math.isnan(one[k]) or k != 2)


def test_nan_is_missing_to_scores(spark):
    df = spark.createDataFrame([(NAN, 0.5), (None, 0.5), (0.5, 0.5)], "a double, b double")
    for invert in (False, True):
        got = [r[0] for r in df.select(scoring.normalize(F.col("a"), 0.0, 1.0, invert)).collect()]
        assert got == [None, None, 0.5]


@pytest.mark.parametrize("body,status", [
    ('{"lat":1}', 200), ('{"lat":1}{"lat":2}', 400), ('{"lat":1} junk }', 400), ("{'lat':1}", 400), ('{"a":1}],[{"b":2}', 400), ('{"a":1},{"b":2}', 400),
    (' {"lat": 1, "deep": {"x": [1, {"y": 2}]}} ', 200), ("[1]", 500), ("", 400), (None, 400)])
def test_requests_are_one_json_record(spark, body, status):
    df = spark.createDataFrame([(body,)], "body string")
    assert clean.route(readers.decode_requests(df)).first().status == status


def test_promotion_follows_the_schedule(spark):
    sizes = {(2, 0): 12, (2, 1): 4, (2, 2): 2, (1, 0): 6, (1, 1): 2, (0, 0): 4}
    rows = [("m", 100 * b + 10 * r + k, b, r, float(k)) for (b, r), n in sizes.items() for k in range(n)]
    out = tuning.rung_promotion(spark.createDataFrame(rows, "model string, trial_id long, bracket long, round long, score double"))
    got = {(r[0], r[1]): r[2] for r in out.groupBy("bracket", "round").agg(F.count_if("promoted")).collect()}
    assert got == {(2, 0): 4, (2, 1): 2, (2, 2): 0, (1, 0): 2, (1, 1): 0, (0, 0): 0}


def test_trials_as_tuners_leave_them(spark, tmp_path):
    for model in ("dust", "slope"):
        for k in range(2):
            folder = tmp_path / model / "untitled_project" / f"trial_{k:04d}"
            folder.mkdir(parents=True)
            (folder / "trial.json").write_text(json.dumps({"trial_id": str(k), "score": 1.5, "status": "COMPLETED"}))
            (folder / "build_config.json").write_text('{"input_shape": [1]}')
    rows = readers.trial_scan(spark, str(tmp_path)).collect()
    assert sorted((r.model, r.trial_id) for r in rows) == [("dust", "0"), ("dust", "1"), ("slope", "0"), ("slope", "1")]
    (tmp_path / "notes.txt").write_text("no trial")
    files = {r.file.rsplit("/", 1)[1]: (r.layout, r.model) for r in readers.trial_files(spark, str(tmp_path)).collect()}
    assert files["notes.txt"] == files["build_config.json"] == (None, None) and files["trial.json"][0] == "tuner"


def test_code_reaches_workers_from_another_folder(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from siterank.session import local_session, ship_package
from siterank.operators.dense_net import Net, net_column
spark = local_session("1")
ship_package(spark)
df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
print("answer", df.select(net_column(Net.random(2, [3]), "x", "batches")).first()[0] is not None)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "answer True" in done.stdout, done.stderr[-2000:]


def test_sites_stay_where_they_are_when_scaled_by_group(spark, monkeypatch):
    from siterank.operators import ordering
    from siterank.operators.scaling import robust_stats, scale_by_group
    df = spark.createDataFrame([(k, "abc"[k % 3], float(k * k)) for k in range(60)] + [(99, None, 1.0)], "k long, g string, v double")
    stats = robust_stats(df, ["v"], by=["g"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scale_by_group(df, stats, ["g"], ["v"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        monkeypatch.setattr(ordering, "BROADCAST_ROWS", 0)
        other = scale_by_group(df, stats, ["g"], ["v"])
        assert "SortMergeJoin" in other._jdf.queryExecution().executedPlan().toString()
        assert plain(out.collect()) == plain(other.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
