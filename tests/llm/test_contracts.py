"""Queries with SQL against it, on the smallest tables."""

import pytest
from oracle import same

from recordsieve.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(name, spark, sf_dir):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)
