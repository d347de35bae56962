"""Every registered query with SQL gives the SQL's rows."""

from __future__ import annotations

import pytest
from oracle import DATA, by_sql, differences

from tidemark import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    assert differences(got, by_sql(catalog.oracle_sql()[name])) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_has_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
