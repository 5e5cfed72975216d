"""Every registered query against its check SQL."""

import pytest

import __spark_entry__ as driver
from tests.compare import differences, duck

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, connection):
    result = QUERIES[name](spark, folder)
    if name in ORACLES:
        assert differences(result, connection, ORACLES[name]) == ""
    else:
        assert result.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() == 5
