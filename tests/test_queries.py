"""Every registered query against its SQL, and the shape of plans that must scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from compare import connect, differences  # noqa: E402

from siterank.plans import catalog  # noqa: E402

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


def test_entry_returns_ten_sites(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 10
    assert [x.landing_score for x in rows] == sorted((x.landing_score for x in rows), reverse=True)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "coregister_layers", "coregister_layers_tiled", "quantile_bin_join", "apply_scaler_join", "rank_sites",
    "rank_sites_shared", "terrain_features", "predict_sites", "trial_lineage", "param_grid", "quantile_grid_sorted"])
def test_no_cross_join_and_no_python_in_plan(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text


def test_serving_adds_no_shuffle(spark, sf):
    """Scoring is narrow: the only exchanges are those that build the sites."""
    from siterank.sources import views
    served = plan(QUERIES["predict_sites_full"](spark, sf))
    assert served.count("Exchange hash") <= plan(views.sites(spark, sf)).count("Exchange hash")


def test_only_needed_columns_are_read(spark, sf):
    text = plan(QUERIES["log_target"](spark, sf))
    schema = [line for line in text.splitlines() if "lineitem" in line][0]
    assert "l_discount" in schema and "l_partkey" not in schema and "l_tax" not in schema.split("ReadSchema")[1]


def test_layers_are_pruned(spark, sf):
    from siterank.sources import readers, views
    path = views.stored_raster(spark, sf)
    text = plan(readers.raster_scan(spark, path, ["slope"]))
    pruned = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "layer" in pruned and "slope" in pruned
