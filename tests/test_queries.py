"""Every registered query: equal to its SQL, or at least runnable."""

import pytest
from check import SF, compare, oracle_rows

import __spark_entry__ as entry

SLOW = {"reduce_spectral", "reduce_layout"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    assert compare(df, *oracle_rows(SF, entry.oracle_sql()[name])) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
