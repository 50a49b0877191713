import pytest

import __spark_entry__ as entry_module
from lodestrata import queries

from .compare import connect, same


@pytest.fixture(scope="module")
def sql(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, spark, folder, sql):
    same(queries.QUERIES[name](spark, folder), sql, queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert 0 < len(rows) <= 20
    assert set(queries.QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
