"""Queries on texts against their reference SQL on the smallest tables; those without SQL run."""

import pytest

from notegraph.llm.queries import QUERIES, SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, parity):
    parity(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0
