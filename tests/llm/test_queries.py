"""The registered queries against DuckDB where SQL can express them."""

import pytest

from sonaris.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, same, name):
    same(queries.queries()[name](spark, sf), SQL[name])


def test_entry_adds_them(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(queries.queries()) | {"pipeline"} <= names and set(SQL) <= set(e.oracle_sql())
