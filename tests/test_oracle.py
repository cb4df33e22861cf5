"""Every query with SQL agrees with DuckDB in columns, types and values."""

import pytest

import __spark_entry__ as contract
from compare import differences, oracle_connection

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    assert differences(contract.queries()[name](spark, sf_dir), con, ORACLES[name]) == []
