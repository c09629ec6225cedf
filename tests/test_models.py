"""Fits reach their accuracy floors, survive saving, and nets train as written."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from siterank.operators import tuning
from siterank.operators.dense_net import Net, score_net
from siterank.operators.estimators import FourierRegressor, NetRegressor
from siterank.operators.net_search import best_net, hyperband
from siterank.operators.net_training import NetRows, NetState, fit_net, run_pass
from siterank.operators.regressors import BOOSTED, FOREST, gradient_boosting, model_pipeline, random_forest
from siterank.operators.tuning import brackets
from siterank.plans import fitting, scans
from siterank.plans.properties import SPECS, PropertySpec, fit_property, measured_samples, prepare
from siterank.plans.state import ServingState, load_state, save_state
from siterank.sources import views

MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,floor", [
    ("random_forest", 97.0), ("gradient_boosting", 97.0), ("mlp_fit", 93.0), ("rbf_regression", 90.0)])
def test_fit_reaches_floor(spark, name, floor):
    row = fitting.REPORTS[name](spark, MID).first()
    assert row.r2_percent > floor and row.n > 2500


def test_feature_importance_is_sorted(spark):
    rows = fitting.importance_report(spark, MID).collect()
    assert rows[0].feature == "elevation"
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_saved_model_predicts_the_same(spark, sf):
    row = scans.model_store(spark, sf).first()
    assert row.n > 1000 and row.largest_difference == 0.0


def test_approximate_stats_are_close(spark):
    from siterank.operators.scaling import collect_stats, robust_stats, robust_stats_approx
    sites = views.sites(spark, MID)
    exact, near = (collect_stats(f(sites, ["elevation", "roughness"])) for f in (robust_stats, robust_stats_approx))
    for c in exact:
        assert near[c] == pytest.approx(exact[c], rel=5e-3)


def test_five_properties_are_fitted_stored_and_loaded(spark, tmp_path):
    """Full specifications with trees, nets and Fourier regression: accuracy, and equal predictions after a round trip."""
    models = []
    reports = {r.property: r for r in fitting.property_report(spark, MID, models).collect()}
    fitted = {s.name: m for s, m in zip(SPECS, models)}
    assert [len(s.features) for s in SPECS] == [8, 6, 5, 4, 8]
    for spec in SPECS:
        row = reports[spec.name]
        assert row.r2 > {"water": 0.75}.get(spec.name, 0.85) and row.mae >= 0 and row.transform == spec.transform
    save_state(spark, ServingState({}, regressors=fitted), str(tmp_path / "state"))
    loaded = load_state(spark, str(tmp_path / "state")).regressors
    rows = measured_samples(views.samples(spark, "/root/testdata/sf0.001")).persist()
    for spec in SPECS:
        one, other = (f.predict(prepare(spec, rows), "p").orderBy("site_id").select("site_id", "p").collect() for f in (fitted[spec.name], loaded[spec.name]))
        assert one == other and all(r.p is not None and r.p == r.p for r in one)
    rows.unpersist()


def test_leaky_spec_fits_target_on_all_rows(spark, sf):
    rows = views.samples(spark, sf)
    base = dict(name="t", target="y_temp", features=("elevation", "albedo"), transform="shift_log")
    whole = fit_property(PropertySpec(**base, leaky=True), rows)[0].target.lowest
    assert whole == rows.agg(F.min("y_temp")).first()[0]
    assert fit_property(PropertySpec(**base), rows)[0].target.lowest >= whole


def test_default_settings_are_the_tuned_ones():
    assert gradient_boosting("slope").getMaxIter() == 195 and random_forest("surface_temp").getNumTrees() == 123
    assert set(BOOSTED) == set(FOREST) == {"slope", "surface_temp", "thermal_inertia"}


def test_bracket_schedule():
    assert brackets(25, 3) == [[(12, 3), (4, 9), (2, 25)], [(6, 9), (2, 25)], [(4, 25)]]


@pytest.fixture(scope="module")
def waves(spark):
    """A smooth target of two inputs: training and validation rows."""
    df = spark.range(3000).select(F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("x"), (F.sin("id") * F.cos(F.col("id") * 3) + F.sin("id")).alias("t"), "id")
    return df.where("id % 5 > 0"), df.where("id % 5 = 0")


def test_hyperband_resumes_promoted_trials(spark, waves, tmp_path):
    rows = NetRows.of(waves[0], "x", "t", validation=waves[1])
    path = str(tmp_path / "trials")
    table = hyperband(rows, 2, path, max_resource=9).collect()
    plan = brackets(9, 3)
    by_rung = {}
    for t in table:
        by_rung.setdefault((t.bracket, t.round), []).append(t)
    assert {k: len(v) for k, v in by_rung.items()} == {(len(plan) - 1 - i, r): n for i, rungs in enumerate(plan) for r, (n, _) in enumerate(rungs)}
    known = {t.trial_id: t for t in table}
    assert len(known) == len(table)
    settings = lambda t: (t.layers, t.units, t.activation, t.learning_rate)
    starts = [settings(t) for t in table if t.round == 0]
    assert len(set(starts)) == len(starts)
    for t in table:
        if t.round:
            parent = known[t.parent_id]
            assert t.first_loss <= parent.last_loss and settings(t) == settings(parent) and t.steps > parent.steps
    # promotion agrees with the operator over trial tables, lineage with the operator over parents
    promoted = tuning.rung_promotion(spark.read.parquet(path).drop("vector"), 9).where("promoted").select("trial_id")
    assert {r.trial_id for r in promoted.collect()} == {t.parent_id for t in table if t.round}
    assert {r.hops for r in tuning.lineage(spark.read.parquet(path)).collect()} <= {0, 1, 2}
    again = hyperband(rows, 2, str(tmp_path / "again"), max_resource=9).collect()
    plain = lambda ts: sorted((t.trial_id, t.parent_id, t.first_loss, t.last_loss, t.score, t.vector) for t in ts)
    assert str(plain(again)) == str(plain(table))  # nothing depends on scheduling
    rows.release()
    assert best_net(spark.read.parquet(path), 2).size > 0


def test_hyperband_goes_on_behind_stored_rungs(spark, waves, tmp_path):
    rows = NetRows.of(waves[0], "x", "t", validation=waves[1])
    whole = hyperband(rows, 2, str(tmp_path / "whole"), max_resource=4, factor=2)
    cut = str(tmp_path / "cut")
    first = whole.where("resource = 1")
    first.write.parquet(cut)
    resumed = hyperband(rows, 2, cut, max_resource=4, factor=2, resume=True)
    plain = lambda df: [tuple(r) for r in df.drop("started").orderBy("trial_id").collect()]
    assert str(plain(resumed)) == str(plain(whole))
    rows.release()


def test_random_search_scores_all_and_returns_the_best(spark, sf):
    scores, held_out = fitting.search_report(spark, sf)
    rows = scores.collect()
    assert [r.candidate for r in rows] == list(range(6)) and all(r.mean_r2 > 0.8 for r in rows)
    assert held_out.first().r2_percent > 90.0


@pytest.mark.parametrize("estimator", [NetRegressor(layers=[16], passes=3), FourierRegressor(size=30)], ids=["net", "fourier"])
def test_own_estimators_join_pipelines(spark, sf, tmp_path, estimator):
    rows = views.samples(spark, sf).select("site_id", *fitting.TEMP, F.col("y_temp").alias("label")).na.drop("any")
    estimator.save(str(tmp_path / "unfitted"))
    loaded = type(estimator).load(str(tmp_path / "unfitted"))
    assert {p.name: v for p, v in loaded.extractParamMap().items()} == {p.name: v for p, v in estimator.extractParamMap().items()}
    model = model_pipeline(fitting.TEMP, loaded).fit(rows)
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    one, other = (m.transform(rows).orderBy("site_id").select("prediction").collect() for m in (model, again))
    assert one == other and len(one) > 1000
    empty = model_pipeline(fitting.TEMP, estimator)
    with pytest.raises(Exception):
        empty.fit(rows.where("false"))


def test_one_job_a_pass_and_equal_results(spark, waves):
    rows = NetRows.of(waves[0].unionByName(waves[0].limit(3).withColumn("t", F.lit(None).cast("double"))), "x", "t", validation=waves[1])
    states = {"a": NetState(Net.random(2, [8, 8], "tanh")), "b": NetState(Net.random(2, [4], "relu", 1), 0.001)}
    spark.sparkContext.setJobGroup("pass", "one pass")
    one = run_pass(rows, states)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pass")) <= 2  # adaptive execution may run the shuffle as a job
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    other = run_pass(rows, states)
    for k in states:
        assert np.array_equal(one[k][0].vector(), other[k][0].vector()) and one[k][1:] == other[k][1:]
        assert np.array_equal(run_pass(rows, states, train=False)[k][0].vector(), states[k].vector())
    rows.release()


@pytest.mark.parametrize("activation", ["relu", "tanh", "elu"])
def test_gradient_is_right(activation):
    net = Net.random(3, [4, 5], activation, seed=1)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    grad, _ = net.gradient(x, y)
    flat, eps = net.flat(), 1e-6
    for i in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[i] = eps
        up, down = (net.replaced(flat + s).gradient(x, y)[1] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-5)


def test_both_net_engines_agree_and_keep_nulls(spark):
    for activation in ("relu", "tanh", "elu"):
        net = Net.random(2, [6], activation)
        df = spark.createDataFrame([([0.5, -2.0],), ([1.5, 0.1],), (None,)], "x array<double>")
        a, b = ([r.z for r in score_net(df, net, "x", "z", engine=e).collect()] for e in ("expression", "batches"))
        assert a[:2] == pytest.approx(b[:2]) and a[2] is None and b[2] is None


def test_training_lowers_loss_and_stops_early(spark):
    df = spark.range(300).select(F.array(F.sin("id"), F.cos("id")).alias("x"), (F.sin("id") * 2.0).alias("t")).repartition(5)
    net, history = fit_net(df, "x", "t", Net.random(2, [8], "tanh"), passes=12, learning_rate=0.05, batch=8)
    assert history[-1]["loss"] < history[0]["loss"] / 10
    _, short = fit_net(df, "x", "t", net, passes=25, learning_rate=0.0, validation=df, patience=2, min_delta=1e-3)
    assert len(short) == 3
    _, tail = fit_net(df.withColumn("k", F.monotonically_increasing_id()), "x", "t", net, passes=2, order=["k"], tail=0.2)
    assert all("val_loss" in h for h in tail)


def test_estimator_factory_builds_from_settings(spark, sf):
    spec = PropertySpec("t", "y_temp", ("elevation", "albedo"), settings={"maxIter": 3},
                        factory=lambda s: GBTRegressor(labelCol="label", featuresCol="features", **s))
    assert fit_property(spec, views.samples(spark, sf))[0].model.stages[-1].getNumTrees == 3


def test_serving_with_regressors_has_no_shuffle(spark, sf):
    state = fitting.regressed_state(spark, sf)
    assert set(state.regressors) == {"surface_temp", "thermal_inertia"}
    from siterank.plans.serving import predict_sites
    sites = views.sites(spark, sf).select("*")
    path_free = spark.createDataFrame(sites.limit(50).collect(), sites.schema)
    out = predict_sites(path_free, state)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("surface_temp_xgb is null or thermal_inertia_xgb is null").count() == 0


def test_sums_of_a_pass_do_not_depend_on_the_order_of_tasks(spark):
    rng = np.random.default_rng(3)
    blocks = [[(rng.normal(size=2).tolist(), float(rng.normal()), bool(i % 5 == 0)) for i in range(40 + 7 * b)] for b in range(11)]
    state, out = NetState(Net.random(2, [8], "tanh")), []
    for order in (range(11), range(10, -1, -1), [5, 0, 7, 3, 10, 1, 9, 2, 8, 4, 6]):
        rdd = spark.sparkContext.union([spark.sparkContext.parallelize(blocks[b], 1) for b in order])
        data = spark.createDataFrame(rdd, "x array<double>, t double, held boolean")
        rows = NetRows(data, data.where("not held").count())
        after, loss, score = run_pass(rows, {0: state, 1: state}, 0)[1]
        out.append((after.vector().tobytes(), after.steps, loss, score))
    assert out[0] == out[1] == out[2]


def test_training_tasks_have_bounded_rows(spark, sf, monkeypatch):
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    monkeypatch.setattr(fitting, "ROWS_PER_TASK", n // 20)
    assert fitting._labelled(spark, sf)[0].rdd.getNumPartitions() >= 20


def test_fitted_serving_builds_its_samples_once(spark, sf):
    files = fitting.predict_sites_fitted(spark, sf).inputFiles()
    assert files and all("fitted-samples" in f for f in files)


@pytest.mark.parametrize("activation", ["relu", "tanh", "elu", "selu"])
@pytest.mark.parametrize("units", [[16], [9, 7]])
def test_steps_in_place_are_those_of_the_gradient(activation, units, monkeypatch):
    """A round of 32-bit steps against Adam on the plain gradient; it needs no ``Net.gradient``, which makes new arrays in each step."""
    from siterank.operators.net_training import outputs
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(75, 3)), rng.normal(size=75)
    start = NetState(Net.random(3, units, activation, 1), 0.01, steps=3, first=np.full(Net.random(3, units).size, 1e-3), second=np.full(Net.random(3, units).size, 1e-2))
    order, (flat, m, v), steps = np.random.default_rng(6).permutation(75), np.split(start.vector(), 3), start.steps
    for lo in range(0, 75, 32):
        some = order[lo:lo + 32]
        grad, steps = start.net.replaced(flat).gradient(x[some], y[some])[0] / len(some), steps + 1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        flat = flat - 0.01 * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)
    monkeypatch.setattr(Net, "gradient", None)
    after = start.stepped(x, y, np.random.default_rng(6))
    assert after.steps == steps == 6
    for one, other in zip(np.split(after.vector(), 3), (flat, m, v)):
        assert one == pytest.approx(other, rel=1e-3, abs=1e-5)
    assert outputs(after.net, x) == pytest.approx(after.net.layers(x)[-1][:, 0], rel=1e-4, abs=1e-5)
