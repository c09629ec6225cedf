"""Golden scores, properties of the score, and null handling."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siterank.constants import PROPERTIES
from siterank.functions import scoring, targets
from siterank.functions.features import feature_vector, feature_vector_by_name
from siterank.functions.geometry import pixel_x, pixel_y
from siterank.functions.layers import layer_key

SCHEMA = ", ".join(f"{p} double" for p in PROPERTIES)
GOLDEN = [
    ((0, 0, 0, 0, 0), 70.00), ((0, .60, -40, 400, 8), 100.00), ((5, .70, -90, 100, 1), 0.00),
    ((2.5, .65, -65, 250, 4.5), 50.00), ((2.1, .15, -42.3, 450.2, .05), 76.48), ((30, .64, -75, 180, 3), 26.19),
    ((1, .62, -44.8, 445.2, 2), 79.51), ((1, .62, -44.8, 0, 2), 59.51),
]


def score(spark, rows, **kw):
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], SCHEMA)
    df = df.withColumn("_i", F.monotonically_increasing_id())
    out = df.select("_i", scoring.site_score({p: F.col(p) for p in PROPERTIES}, **kw).alias("s"))
    return [r.s for r in out.orderBy("_i").collect()]


def test_golden_scores(spark):
    assert score(spark, [g[0] for g in GOLDEN]) == pytest.approx([g[1] for g in GOLDEN], abs=0.0101)


def test_missing_prediction_gives_no_score_unless_asked(spark):
    row = (1.0, None, -50.0, 200.0, 3.0)
    assert score(spark, [row]) == [None]
    df = spark.createDataFrame([row], SCHEMA)
    assert df.select(scoring.score_or_zeros({p: F.col(p) for p in PROPERTIES})).first()[0] == 70.0


def test_empty_weights_mean_defaults_and_others_are_not_renormalised(spark):
    best = (0, .60, -40, 400, 8)
    assert score(spark, [best], weights={}) == [100.0]
    assert score(spark, [best], weights=dict.fromkeys(PROPERTIES, 1.0)) == [500.0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 40), st.floats(0, 1), st.floats(-150, 30), st.floats(-10, 900),
                          st.floats(-2, 12)), min_size=20, max_size=60))
def test_score_is_bounded_and_monotone(spark, rows):
    base = score(spark, rows)
    assert all(0 <= s <= 100 for s in base)
    for i, worse in ((0, True), (1, True), (2, False), (3, False), (4, False)):
        moved = score(spark, [tuple(v + 0.5 * (k == i) for k, v in enumerate(r)) for r in rows])
        assert all((b <= a) if worse else (b >= a) for a, b in zip(base, moved))


def test_clamp_of_nan_null_and_range(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, nan, nan, nan, nan), (-1.0, 2.0, -500.0, -3.0, 9.0), (None,) * 5], SCHEMA)
    rows = df.select(*(c.alias(p) for p, c in scoring.clamp({p: F.col(p) for p in PROPERTIES}).items())).collect()
    assert rows[0][:2] == (0.0, 0.0) and math.isnan(rows[0][2]) and rows[0][3:] == (0.0, 0.0)
    assert tuple(rows[1]) == (0.0, 1.0, -500.0, 0.0, 8.0)
    assert tuple(rows[2]) == (None,) * 5


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 29.99, 30.0, 50.0, 70.0, 75.0, 90.0, None)], "s double")
    got = [tuple(r) for r in df.select(scoring.band_ui(F.col("s")), scoring.band_doc(F.col("s"))).collect()]
    assert got == [("Poor", "Very poor"), ("Poor", "Very poor"), ("Fair", "Poor"), ("Good", "Fair"),
                   ("Excellent", "Good"), ("Excellent", "Good"), ("Excellent", "Excellent"), (None, None)]


def test_unknown_model_raises_or_gives_zeros(spark):
    with pytest.raises(ValueError):
        feature_vector("gravity")
    df = spark.createDataFrame([("dust",), ("gravity",)], "m string").select(
        "m", *(F.lit(1.0).alias(c) for c in ("elevation", "slope", "temperature", "albedo", "roughness", "ferric", "tempRange")))
    loose = df.select(feature_vector_by_name(F.col("m"), strict=False)).collect()
    assert [len(r[0]) for r in loose] == [6, 8] and loose[1][0] == [0.0] * 8
    with pytest.raises(Exception, match="unknown model: gravity"):
        df.select(feature_vector_by_name(F.col("m"))).collect()


def test_pixels_at_the_border(spark):
    df = spark.createDataFrame([(0.0, 180.0), (-90.0, 0.0), (90.0, -180.0)], "lat double, lon double")
    rows = df.select(pixel_x(F.col("lon"), F.lit(64)), pixel_y(F.col("lat"), F.lit(32))).collect()
    assert [tuple(r) for r in rows] == [(64, 16), (32, 32), (0, 0)]


def test_layer_keys(spark):
    names = {"Elevation (MOLA)": "elevation", "Lambert Albedo": "lambertAlbedo", "Albedo": "albedo",
             "Temperature Range": "tempRange", "Temperature": "temperature", "Crustal Thickness": "crustalThickness",
             "Unknown": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", layer_key(F.col("n"))).collect()} == names


def test_normal_distribution(spark):
    from statistics import NormalDist
    n = NormalDist()
    us = [1e-9, 1e-7, 1e-4, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.97575, 0.999, 1 - 1e-6, 1.0]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    out = targets.with_normal_ppf(df, "u", "z").withColumn("back", targets.normal_cdf(F.col("z"))).collect()
    for u, row in zip(us, out):
        expected = n.inv_cdf(min(max(u, 1e-7), 1 - 1e-7))
        assert row.z == pytest.approx(expected, abs=1e-8)
        assert row.back == pytest.approx(n.cdf(row.z), abs=1e-14)


def test_log_and_shift_log_round_trip(spark):
    df = spark.createDataFrame([(-80.0,), (-12.5,), (3.0,)], "y double")
    low = F.lit(-80.0)
    shifted = df.select("y", targets.shift_log_inverse(targets.shift_log_target(F.col("y"), low), low).alias("b"),
                        targets.log_inverse(targets.log_target(F.abs("y"))).alias("c")).collect()
    assert all(r.b == pytest.approx(r.y) and r.c == pytest.approx(abs(r.y)) for r in shifted)
