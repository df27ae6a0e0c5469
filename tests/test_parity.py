"""Every core query that has reference SQL gives the same rows on the smallest tables; every other one runs."""

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

MODULES = [m for m in entry._modules() if not m.__name__.startswith("notegraph.llm")]
QUERIES = {name: (query, m.SQL.get(name)) for m in MODULES for name, query in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, parity, spark):
    query, sql = QUERIES[name]
    if sql is None:
        assert query(spark, DATA).count() >= 0
    else:
        parity(query, sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
