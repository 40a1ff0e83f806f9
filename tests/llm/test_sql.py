"""Operators whose results SQL can express, against DuckDB."""

import pytest

from tests.oracle import DATA, both
from tidewire.llm.queries import QUERIES
from tidewire.llm.sql import SQL


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    found, want = both(spark, QUERIES[name], SQL[name])
    assert found == want
