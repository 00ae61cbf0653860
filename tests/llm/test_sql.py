"""Queries of the operators that SQL can express give the SQL's rows."""

import pytest

from octaray.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
