"""Every registered query against its SQL at sf0.01, and the driver contract."""

import pytest

import __spark_entry__ as contract
from tests.oracle import SF_DIR, compare

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_contract(spark):
    assert set(ORACLE) <= set(QUERIES)
    assert contract.entry(spark).count() == 1
