"""Every registered query against its oracle, over whole tables."""
import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, n, info = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert status in ("ok", "rows-only"), (status, n, info)
    assert n >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
