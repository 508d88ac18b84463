"""Every registered query against its SQL; queries without SQL must return rows."""

import pytest
from oracle import compare, connect

from tidegauge.plans.everything import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, con, name):
    assert compare(QUERIES[name](spark, data), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if "y_hat" in df.columns and "status" in df.columns:
        assert all(r.y_hat is not None for r in rows if r.status == "ok")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
