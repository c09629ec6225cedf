"""Readers, stores, request routing and streams on small hand-written inputs."""

import json

import pytest
from pyspark.sql import functions as F

from siterank.operators import clean, tuning
from siterank.plans.serving import predict_sites, rule_nets
from siterank.sources import readers, sinks, views
from siterank.sources.cache import LayerCache
from siterank.streaming.scoring import score_requests, stream_score


def test_csv_encodings_and_padded_headers(spark, tmp_path):
    (tmp_path / "in put").mkdir()
    (tmp_path / "in put" / "a.csv").write_bytes("place,t\nGräben,1\n".encode("utf-8"))
    (tmp_path / "in put" / "b.csv").write_bytes("place,t\nMärz,2\n".encode("latin-1"))
    rows = readers.csv_scan_encoding(spark, str(tmp_path / "in put"), "place string, t int").collect()
    assert sorted((r.place, r.t) for r in rows) == [("Gräben", 1), ("März", 2)]
    (tmp_path / "c.csv").write_text(" a , b\n1,2\n")
    assert readers.csv_scan_raw(spark, str(tmp_path / "c.csv")).columns == ["a", "b"]


def test_csv_encoding_is_decided_by_the_file(spark, tmp_path):
    """A latin-1 file keeps lines that happen to be valid UTF-8; quoted commas, blank lines and split files parse as usual."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_bytes('p,t\n"x, y",1\n\nGräben,2\n'.encode("utf-8"))
    (folder / "b.csv").write_bytes("p,t\nMärz,3\nÃ©,4\n".encode("latin-1") + b"".join(f"row{i},{i}\n".encode() for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = readers.csv_scan_encoding(spark, str(folder), "p string, t int")
        rows = sorted((r.p, r.t) for r in scan.collect() if not r.p.startswith("row"))
        assert rows == [("Gräben", 2), ("März", 3), ("x, y", 1), ("Ã©", 4)] and scan.count() == 2004
        assert scan._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 2  # each byte is read twice by one plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("p,t\n")
    assert readers.csv_scan_encoding(spark, str(tmp_path / "empty"), "p string, t int").count() == 0


def test_region_files_are_one_scan(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, x double"), spark.createDataFrame([(2, "n")], "k int, y string")
    a.write.parquet(str(tmp_path / "r" / "region=white plain"))
    b.write.parquet(str(tmp_path / "r" / "black+1"))
    out = readers.union_region_files(spark, str(tmp_path / "r"))
    rows = out.orderBy("k").select("k", "x", "y", "region").collect()
    assert [tuple(r) for r in rows] == [(1, 2.0, None, "white plain"), (2, None, "n", "black+1")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, x double"), spark.createDataFrame([(2, "n")], "k int, y string")
    rows = clean.union_regions({"white": a, "black": b}).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 2.0, "white", None), (2, None, "black", "n")]


def test_layer_cache_reads_once(spark, sf):
    cache = LayerCache(spark, views.stored_raster(spark, sf))
    first = cache.load("slope")
    assert cache.load("slope") is first and first.is_cached
    assert first.select("layer").distinct().collect()[0].layer == "slope"
    cache.clear()
    assert not first.is_cached


def requests(spark):
    bodies = ['{"lat": 1, "lon": 2, "slope": 2.34, "albedo": 0.15}', '{"slope": null, "k": 5}', "not json", "null", None,
              '{"slope": "steep"}', "[1, 2]", '{"slope": 1} and more', "12 words"]
    return spark.createDataFrame([(i, "t", b) for i, b in enumerate(bodies)], "request_id long, source string, body string")


def test_requests_are_routed(spark):
    rows = clean.route(readers.decode_requests(requests(spark))).orderBy("request_id").collect()
    assert [r.status for r in rows] == [200, 200, 400, 400, 400, 500, 500, 400, 400]
    assert rows[2].error == "Request must be JSON" and rows[3].error == "Invalid JSON in request body"
    busy = clean.route(readers.decode_requests(requests(spark)), ready=False)
    assert {r.status for r in busy.collect()} == {503}


def test_null_and_missing_keys_get_defaults(spark):
    good, bad = score_requests(requests(spark), rule_nets())
    rows = {r.request_id: r for r in good.collect()}
    assert rows[0].n_defaulted == 5 and rows[1].n_defaulted == 7
    assert all(r.landing_score is not None for r in rows.values())
    assert set(rows) == {0, 1} and bad.count() == 7


def test_responses_nest_predictions(spark, sf):
    served = predict_sites(views.sites(spark, sf), rule_nets())
    doc = json.loads(sinks.encode_responses(served).first().body)
    assert doc["success"] is True and set(doc["predictions"]["neural_networks"]) == {
        "slope", "dust", "surface_temp", "thermal_inertia", "water"}
    assert "lat" in doc["raw_mars_data"]


def trial(tid, score, bracket, rnd, parent=None, **hp):
    values = {**hp, "tuner/epochs": 3, "tuner/bracket": bracket, "tuner/round": rnd}
    if parent:
        values["tuner/trial_id"] = parent
    seen = lambda v, s: {"direction": "min", "observations": [{"value": [v], "step": s}]}
    return {"trial_id": tid, "hyperparameters": {"space": [{"class_name": "Choice", "config": {
        "name": "units", "default": None, "conditions": [], "values": [16, 32], "ordered": True}}], "values": values},
        "metrics": {"metrics": {"loss": seen(score * 2, 2), "val_loss": seen(score, 2)}},
        "score": score, "best_step": 2, "status": "COMPLETED", "message": None}


def test_trial_documents(spark, tmp_path):
    docs = [trial("0000", 5.0, 1, 0, units=16), trial("0001", 3.0, 1, 0, units=32), trial("0002", 9.0, 1, 0, units=16),
            trial("0003", 2.5, 1, 1, parent="0001", units=32)]
    folder = tmp_path / "dust_run"
    folder.mkdir()
    for d in docs:
        (folder / f"{d['trial_id']}.json").write_text(json.dumps(d))
    scan = readers.trial_scan(spark, str(tmp_path))
    values = F.col("hyperparameters.values")
    flat = scan.select(
        "model", F.col("trial_id").cast("long").alias("trial_id"), "score", "best_step",
        values["tuner/bracket"].cast("long").alias("bracket"), values["tuner/round"].cast("long").alias("round"),
        F.try_element_at(values, F.lit("tuner/trial_id")).cast("long").alias("parent_id"), values["units"].alias("units"))
    assert flat.count() == 4 and {r.model for r in flat.collect()} == {"dust_run"}
    metrics = tuning.explode_metrics(scan).filter("metric = 'val_loss'")
    assert sorted(r.value for r in metrics.collect()) == [2.5, 3.0, 5.0, 9.0]
    line = {r.trial_id: r for r in tuning.lineage(flat).collect()}
    assert line[3].root_id == 1 and line[3].hops == 1 and line[3].gain == 0.5 and line[0].hops == 0
    promoted = {r.trial_id for r in tuning.rung_promotion(flat).filter("promoted").collect()}
    assert promoted == {0, 1}  # bracket 1 hands on two, by the published sizes
    assert tuning.best_trials(flat, ["units"]).first().trial_id == 3
    tried = {r.trial_id: r.tried for r in tuning.dedupe(flat, ["units"]).collect()}
    assert tried == {0: 2, 1: 2}


def test_stream_equals_batch_and_replays_once(spark, sf, tmp_path):
    rows = requests(spark).unionByName(views.requests(spark, sf)).repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    nets = rule_nets()
    scored, bad = stream_score(spark, str(tmp_path / "in"), nets, str(tmp_path / "out"), files_per_batch=1)
    stream_score(spark, str(tmp_path / "in"), nets, str(tmp_path / "out"), files_per_batch=1)  # nothing new
    want_good, want_bad = score_requests(spark.read.parquet(str(tmp_path / "in")), nets)
    key = lambda df: sorted((r.request_id, r.source, str(r.landing_score)) for r in df.collect())
    assert key(spark.read.parquet(scored)) == key(want_good)
    assert spark.read.parquet(bad).count() == want_bad.count()
    assert spark.read.parquet(scored).select("batch").distinct().count() == 3


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from siterank import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Session.conf.get = staticmethod(lambda name, default=None: "/shared/x/")
    assert session.shared_dir(Session()) == "/shared/x"


def test_stream_files_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    from siterank.plans import streams
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 100)
    path = str(tmp_path / "in")
    assert streams._arrived(spark.range(1000).coalesce(1), path) == 5
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 10 and max(r["count"] for r in files) == 100
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 3)
    assert streams._arrived(spark.range(1000).coalesce(1), str(tmp_path / "more")) == 3
