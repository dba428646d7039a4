"""Queries that SQL can express, over the sample tables."""

from __future__ import annotations

import pytest
from compare import same

from citeweave.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), SQL[name], sf_dir)
