import pytest

from orbitalis.plans import catalog, more_queries, walk_queries  # noqa: F401
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 500
    assert set(e.oracle_sql()) <= set(e.queries())
