"""Every registered query against its SQL twin, or for rows where there is none."""

import pytest
from compare import TESTDATA, connect, differences

import __spark_entry__ as entry

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    run, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert run(spark, SF_DIR).count() > 0
    else:
        assert differences(spark, con, SF_DIR, run, sql) is None
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() == 10
