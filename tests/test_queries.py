"""Every registered query with SQL against DuckDB on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from sparkloom import plans

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(plans.oracle_sql()) <= set(plans.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, name):
    assert compare.compare(spark, SF, [name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
