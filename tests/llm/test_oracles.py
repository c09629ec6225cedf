"""Every query that SQL can express gives the SQL's rows."""

import compare
import pytest

from siterank.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert compare.differences(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name]) == []


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
