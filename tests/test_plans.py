import pytest

import __spark_entry__ as entry

from .compare import both, database

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_query_matches_sql(spark, data, connection, name):
    ours, theirs = both(spark, connection, data, entry.queries()[name], SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_has_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["work", "title", "score", "popularity"]
    assert found.count() == 100
