"""Queries with SQL against DuckDB, on whole tables."""

from __future__ import annotations

import pytest
from compared import assert_same, tables

from covenant.llm.oracles import ORACLES
from covenant.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], tables(sf_dir))
