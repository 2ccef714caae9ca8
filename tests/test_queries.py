"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.compare import compare, connect
from webtables.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    good, note, _ = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert good, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
