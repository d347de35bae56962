"""Queries with SQL give the SQL's rows, over the whole tables."""

from __future__ import annotations

import pytest
from oracle import DATA, by_sql, differences

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    assert differences(got, by_sql(queries.oracle_sql()[name])) == ""
