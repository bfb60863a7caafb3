import os

import pytest

import __spark_entry__ as entry_points
from compare import differences, duck
from fleetstats.plans.catalog import load_all

FOLDER = os.environ.get("CATALOGUE_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, connection, name):
    assert differences(spark, connection, FOLDER, QUERIES[name], ORACLES[name]) == []


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["host", "name", "ts", "event_id", "k", "k_rate", "reset"]
    assert df.count() > 0
