"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"
# needs more rows than the smallest tables hold
SPARSE = {"lowest_shares_of_rich", "purchases_zero_inflated_selected", "repeated_prices", "share_of_large_balances"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    diff = compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert diff is None or (name in SPARSE and diff == "no rows"), diff


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_name", "n_orders", "net"] and df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
