"""Every registered query with SQL gives the rows of that SQL."""

import pytest

import __spark_entry__ as entry
from tests import comparing

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return comparing.connect(data)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, data, connection, name):
    df = QUERIES[name](spark, data)
    columns, rows = comparing.spark_rows(df)
    expected_columns, expected = comparing.duck_rows(connection, ORACLES[name])
    assert columns == expected_columns
    assert comparing.types_differ(df, connection, ORACLES[name]) == {}
    assert rows == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"qid", "prediction", "confidence", "rank", "line"} <= set(df.columns)
