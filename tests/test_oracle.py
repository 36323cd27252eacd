"""Every SQL-checked query against DuckDB on the same parquet (sf0.001 by
default; RISKFRAME_TEST_SF overrides)."""

import os

import pytest

import __spark_entry__ as E
from riskframe.plans.oracle import compare, duck

SF = os.environ.get("RISKFRAME_TEST_SF", "/root/testdata/sf0.001")
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF), SQL[name], con)
    assert ok, msg


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "ocurrencia" in df.columns and "total_viajes_estacion" in df.columns
    assert df.count() > 0
