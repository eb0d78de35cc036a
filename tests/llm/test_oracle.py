"""Corpus queries that SQL can express against DuckDB, and the registration of all."""

from __future__ import annotations

import pytest

from driftline.llm import queries
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
