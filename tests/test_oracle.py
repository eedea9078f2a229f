"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.limit(1).count() == 1
    else:
        assert compare(df, con, sql) == []


def test_entry(spark):
    assert entry.entry(spark).columns == ["image_id", "label", "n", "white", "total"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)
