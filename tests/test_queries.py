"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, duck_rows, spark_rows

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    if name in ORACLES:
        assert (sorted(names), rows) == (lambda r: (sorted(r[0]), r[1]))(duck_rows(con, ORACLES[name]))
    else:
        assert rows


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 50
    assert sum(r.hashed for r in rows) == sum(r.placed for r in rows) == 1000
