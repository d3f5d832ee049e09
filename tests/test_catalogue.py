"""Every registered query against its SQL."""

import pytest

from vitrine.plans import account, catalogue, upkeep

QUERIES = {**catalogue.queries(), **account.queries(), **upkeep.queries()}
SQL = {**catalogue.oracle_sql(), **account.oracle_sql(), **upkeep.oracle_sql()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, same):
    same(name, QUERIES, SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
