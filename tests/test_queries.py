"""Every query that SQL can express, beside its SQL on DuckDB."""

import pytest
from compare import compare

from quillspark import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, folder, name):
    assert compare(spark, folder, name, plans.QUERIES[name], plans.SQL[name]) == ""


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
