"""Every query of the library with SQL gives the SQL's rows."""

import pytest

from octaray.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ray_id", "t", "triangle_id"]
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())
