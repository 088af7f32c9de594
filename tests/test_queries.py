"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import os

import pytest

from reelspark.plans import catalogue

from .harness import same

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, DIR)
    if name in catalogue.ORACLES:
        same(df, DIR, catalogue.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
