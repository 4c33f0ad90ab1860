"""Every registered query against DuckDB, or at least for rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import differences

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    assert differences(spark, small, name, QUERIES, ORACLES) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_one_row_per_customer_with_orders(spark):
    table = entry(spark)
    assert table.count() == table.select("c_custkey").distinct().count() > 0
