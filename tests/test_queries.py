"""Every query of the reference's operators against DuckDB."""

import pytest
from compare import same

from corpusmill.plans import detail_queries, registry, table_queries, text_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, small, name):
    same(registry.QUERIES[name](spark, small), registry.SQL[name], small)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
