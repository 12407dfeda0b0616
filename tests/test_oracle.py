"""Every registered query against its SQL oracle (DuckDB) on the smallest driver tables."""

import pytest

from conftest import SMALL_SF

import __spark_entry__ as E
from skyledger.plans.compare import compare

NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    df = E.queries()[name](spark, SMALL_SF)
    r = compare(df, duck_small, E.oracle_sql()[name])
    assert r["columns_match"], r
    assert r["types_match"], r
    assert r["rows_match"], r
    assert r["values_match"], r


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_queries_without_oracle_run(spark, name):
    df = E.queries()[name](spark, SMALL_SF)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "FlightStatus" in df.columns
