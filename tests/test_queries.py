"""Every registered query against its SQL, and the driver's contract."""

import pytest
from oracle import assert_same
from siftwell.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, FOLDER), registry.ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
