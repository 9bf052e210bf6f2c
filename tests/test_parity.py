import pytest

from citeloom.plans.registry import ORACLE_SQL, QUERIES
from conftest import DATA
from parity import connect, of_spark, of_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert of_spark(QUERIES[name](spark, DATA)) == of_sql(connect(DATA), ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
