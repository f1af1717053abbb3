"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import pytest

from tessera.plans.catalog import collect
from tests.helpers import same

QUERIES, SQL = collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in SQL:
        same(spark, sf_dir, QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, sf_dir)
        assert df.columns and df.count() >= 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
