"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from layerkit import plans
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_twin(spark, con, name):
    problems = compare(spark, con, QUERIES[name], ORACLE[name], FOLDER)
    # The smallest tables may hold none of the rows a query looks for.
    assert [p for p in problems if p != "no rows"] == []


def test_every_query_of_the_tables_has_a_twin():
    assert set(plans.QUERIES) == set(plans.ORACLE)
    assert set(plans.QUERIES) <= set(QUERIES) and set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["nation", "band", "revenue", "orders"] and df.count() > 0
