"""Every registered query against its SQL; queries without SQL have to return rows."""

import pytest

import __spark_entry__
import oracle

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con(tables):
    return oracle.connect(tables)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, tables, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], tables) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_rows(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lang", "percent", "n"]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
