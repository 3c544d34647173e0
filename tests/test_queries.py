"""Registered queries against DuckDB."""

from __future__ import annotations

import pytest
from helpers import same_as_sql

from brindle.plans.oracles import ORACLE_SQL
from brindle.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    same_as_sql(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
