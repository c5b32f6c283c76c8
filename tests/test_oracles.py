"""Every registered query against its SQL statement."""

import pytest

import __spark_entry__ as driver
from checks.compare import compare, duck
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_statement_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["query_id", "text"] and result.count() > 0


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_equals_sql(spark, connection, name):
    ok, line = compare(
        spark, connection, SF_DIR, name, driver.queries()[name], driver.oracle_sql().get(name)
    )
    assert ok, line
