"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert not problem


def test_flagship_query(spark):
    rows = entry.entry(spark).collect()
    assert [r.tier for r in sorted(rows)] == [0, 1, 2, 3, 4, 5]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
