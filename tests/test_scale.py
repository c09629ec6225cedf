"""Operators for groups of any size against brute force, with one group holding most rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siterank.operators import splitting, tuning
from siterank.operators.ordering import over_rows, with_position
from siterank.operators.quantiles import quantile_grid
from siterank.operators.ranking import rank_scores, rank_sites
from siterank.operators.raster import coregister
from siterank.operators.scaling import QuantileMap, robust_stats, scale_by_group
from siterank.operators.terrain import terrain_features


@pytest.fixture(scope="module")
def skewed():
    """Two thirds of the rows in one group, plus a null group and single-row groups."""
    rng = random.Random(1)
    groups = ["hot"] * 400 + ["warm"] * 150 + [None] * 40 + [f"g{i}" for i in range(10)]
    rng.shuffle(groups)
    return pd.DataFrame({"id": range(len(groups)), "g": groups,
                         "v": [float(rng.randint(0, 40)) / 4 for _ in groups]})


@pytest.fixture(scope="module")
def skewed_df(spark, skewed):
    return spark.createDataFrame(list(skewed.itertuples(index=False, name=None)), "id long, g string, v double").repartition(7)


def test_position_matches_row_number(spark, skewed, skewed_df):
    got = with_position(skewed_df, [F.desc("v"), "id"], ["g"], "seq", size="n").toPandas()
    want = skewed.sort_values(["v", "id"], ascending=[False, True])
    want["seq"] = want.groupby("g", dropna=False).cumcount()
    want["n"] = want.groupby("g", dropna=False)["id"].transform("size")
    pd.testing.assert_frame_equal(got.sort_values("id", ignore_index=True)[["id", "seq", "n"]],
                                  want.sort_values("id", ignore_index=True)[["id", "seq", "n"]], check_dtype=False)


def test_position_spreads_a_group_over_slices(spark, skewed_df):
    from siterank.operators.ordering import sorted_slices
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        slices = sorted_slices(skewed_df, [F.col("g"), F.col("v"), F.col("id")], "t")
        assert slices.filter("g = 'hot'").select("_slice").distinct().count() > 1
        got = with_position(skewed_df, ["v", "id"], ["g"]).groupBy("g").agg(F.max("seq"), F.countDistinct("seq"))
        assert all(r[1] + 1 == r[2] for r in got.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("chunk", [5, 7, 1000])
def test_chunked_windows_match_plain_rolling(spark, skewed, skewed_df, chunk):
    placed = with_position(skewed_df, ["id"], ["g"])
    got = terrain_features(placed, "v", ["g"], "seq", chunk=chunk).toPandas().sort_values("id", ignore_index=True)
    by = skewed.sort_values("id").groupby("g", dropna=False)["v"]
    roll = lambda fn: by.transform(lambda s: getattr(s.rolling(5, center=True), fn)())
    want = pd.DataFrame({
        "v_rolling_mean": roll("mean"), "v_rolling_max_diff": roll("max") - roll("min"),
        "v_diff_abs": by.transform(lambda s: s.diff().abs()), "v_diff2_abs": by.transform(lambda s: s.diff().diff().abs())})
    assert len(got) == len(skewed)
    np.testing.assert_allclose(got[list(want)].to_numpy(float), want.to_numpy(float), atol=1e-9)


def test_frame_wider_than_chunk_is_refused(skewed_df):
    with pytest.raises(ValueError):
        over_rows(skewed_df, ["g"], "id", 9, 0, {}, chunk=5)


def test_rank_sites_and_shared_ranks(spark, skewed, skewed_df):
    scored = skewed_df.withColumn("v", F.when(F.col("v") > 1, F.col("v")))
    ours = rank_sites(scored, ["g"], "v", "id").toPandas().set_index("id").sort_index()
    ties = rank_scores(scored, ["g"], "v").toPandas().set_index("id").sort_index()
    frame = skewed.assign(v=skewed["v"].where(skewed["v"] > 1, -1.0)).set_index("id").sort_index()
    by = frame.groupby("g", dropna=False)["v"]
    assert (ours["site_rank"] == by.rank("first", ascending=False)).all()
    assert (ties["score_rank"] == by.rank("min", ascending=False)).all()
    assert (ties["score_dense_rank"] == by.rank("dense", ascending=False)).all()


@pytest.mark.parametrize("points", [2, 5, 50])
def test_both_quantile_plans_match_numpy(spark, skewed, skewed_df, points):
    for limit in (10**9, 0):
        rows = quantile_grid(skewed_df, ["v"], points, limit=limit).orderBy("i").collect()
        want = np.quantile(skewed["v"], [i / (points - 1) for i in range(points)])
        np.testing.assert_allclose([r.value for r in rows], want, atol=1e-9)


@pytest.mark.parametrize("limit", [10**9, 0])
def test_quantiles_by_group_with_gaps(spark, limit):
    rows = [("a", 1.0, None), ("a", 5.0, float("nan")), ("a", None, 2.0), ("b", 7.0, 3.0), (None, 4.0, 4.0), (None, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r.g, r.feature, r.i): r.value for r in quantile_grid(df, ["x", "y"], 3, ["g"], limit=limit).collect()
           if r.value is not None}
    assert got == {("a", "x", 0): 1.0, ("a", "x", 1): 3.0, ("a", "x", 2): 5.0, ("a", "y", 0): 2.0, ("a", "y", 1): 2.0,
                   ("a", "y", 2): 2.0, ("b", "x", 0): 7.0, ("b", "x", 1): 7.0, ("b", "x", 2): 7.0, ("b", "y", 0): 3.0,
                   ("b", "y", 1): 3.0, ("b", "y", 2): 3.0, (None, "x", 0): 4.0, (None, "x", 1): 6.0, (None, "x", 2): 8.0,
                   (None, "y", 0): 1.0, (None, "y", 1): 2.5, (None, "y", 2): 4.0}


def test_scaling_by_group_keeps_null_group_and_zero_range(spark, skewed_df):
    stats = robust_stats(skewed_df, ["v"], ["g"])
    out = scale_by_group(skewed_df, stats, ["g"], ["v"])
    assert out.count() == skewed_df.count() and out.filter("v is null").count() == 0
    assert out.filter("g like 'g%'").agg(F.max(F.abs("v"))).first()[0] == 0.0


def test_quantile_map_ties_and_round_trip(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=300), np.full(200, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    qm = QuantileMap.fit(df, "x", 41)
    grid, share = np.array(qm.grid), np.arange(41) / 40
    want = 0.5 * (np.interp(x, grid, share) - np.interp(-x, -grid[::-1], -share[::-1]))
    got = qm.uniform(df, "x", "u").select("x", "u").toPandas()
    np.testing.assert_allclose(got["u"], want, atol=1e-9)
    back = qm.inverse(qm.normal(df, "x", "z"), "z", "y").select("x", "y").toPandas()
    np.testing.assert_allclose(back["x"], back["y"], atol=1e-5)
    edge = spark.createDataFrame([(-99.0,), (99.0,), (None,), (float("nan"),)], "x double")
    assert [r.u for r in qm.uniform(edge, "x", "u").collect()] == [0.0, 1.0, None, None]


def brute_stop(losses, patience, delta):
    best, at = None, None
    for i, v in enumerate(losses):
        if best is None or v + delta < best:
            best, at = v, i
        elif i - at >= patience:
            return at, i
    return at, None


@pytest.mark.parametrize("patience,chunk", [(1, 4), (3, 5), (3, 3), (6, 6)])
def test_early_stop_in_chunks_matches_walk(spark, patience, chunk):
    rng = random.Random(patience)
    curves = {t: [round(100 / (1 + i * 0.2) + rng.uniform(-4, 4), 2) for i in range(n)]
              for t, n in enumerate([1, 2, 9, 40, 41, 90, 7])}
    curves[20] = [100.0 - i for i in range(60)]  # always better
    curves[21] = [100.0 - i * 0.001 for i in range(60)]  # never by enough
    rows = [(t, i, v) for t, c in curves.items() for i, v in enumerate(c)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "trial_id long, step long, val_loss double")
    want = {t: brute_stop(c, patience, 0.05) for t, c in curves.items()}
    for fold in (10_000, 8, 0):
        got = tuning.early_stop(df, patience, 0.05, fold_epochs=fold, chunk=chunk).collect()
        assert {r.trial_id: (r.best_step, r.stop_step) for r in got} == want


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    for parts in (1, 9):
        train, test = splitting.train_test_split(df.repartition(parts), ["k"])
        ids = {r.k for r in test.collect()}
        if parts == 1:
            first = ids
        assert ids == first and not ids & {r.k for r in train.collect()} and train.count() + len(ids) == 2000
        order = [r.k for r in splitting.seeded_shuffle(df.repartition(parts), "k").orderBy("seq").collect()]
        if parts == 1:
            first_order = order
        assert order == first_order != sorted(order)
    assert 0.17 < len(first) / 2000 < 0.23


def test_crowded_pixel_and_both_raster_plans(spark):
    rng = np.random.default_rng(3)
    lines = [("slope", y, 2500, 3, rng.normal(size=2500).astype(float).tolist()) for y in range(3)]
    lines += [("albedo", y, 4, 2, [float(y * 4 + x) for x in range(4)]) for y in range(2)]
    raster = spark.createDataFrame(lines, "layer string, y long, width long, height long, pixels array<float>")
    pts = [(i, 10.0, 20.0) for i in range(200)] + [(200 + i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(100)]
    points = spark.createDataFrame(pts + [(900, None, 1.0), (901, 0.0, 180.0)], "site_id long, lat double, lon double")
    small = coregister(points, raster, ["slope", "albedo", "basalt"]).orderBy("site_id").collect()
    tiled = coregister(points, raster, ["slope", "albedo", "basalt"], broadcast_bytes=0).orderBy("site_id").collect()
    assert small == tiled and len(small) == 302
    for r in small[:300]:
        x, y = int((r.lon + 180) / 360 * 2500), int((90 - r.lat) / 180 * 3)
        assert r.slope == pytest.approx(lines[y][4][x], abs=1e-6) and r.basalt is None
    assert small[-1].slope is None and small[-2].slope is None


def test_early_stop_chunks_share_calls(spark, monkeypatch):
    """Chunks of many curves are handled by one call, whatever their keys."""
    monkeypatch.setattr(tuning, "BUCKET_ROWS", 400)
    big = 1 << 60
    keys = [None, *(big + i for i in range(60))]
    rows = [(k, s, float((s * 7919 + (k or 5) % 101 * 31) % 97)) for k in keys for s in range(20)]
    df = spark.createDataFrame(rows, "trial_id long, step long, val_loss double")
    got, want = (tuning.early_stop(df, 3, 0.5, fold_epochs=n, chunk=4) for n in (10, 100))
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas [_bucket" in plan
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
