"""Every registered query against its SQL on the smallest tables."""

import pytest

from bidlens.plans.all import QUERIES, SQL

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert_same(con, QUERIES[name](spark, SF), SQL[name])


def test_entry_module_lists_the_same_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
