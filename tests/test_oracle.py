"""Every registered query against its DuckDB SQL (the driver's gate)."""

import pytest

import __spark_entry__ as E
from runlens import sources as src
from runlens.plans.registry import QUERIES
from conftest import SF_ORACLE
from oracle_compare import compare, duck

ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_has_oracle_or_is_rows_only():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_ORACLE)
    ok, msg = compare(df, con, ORACLE[name])
    assert ok, msg


def test_catalog_rows(spark):
    df = src.read_catalog(spark, SF_ORACLE, glob="*.parquet")
    names = {r.name for r in df.collect()}
    assert {"events.parquet", "orders.parquet", "lineitem.parquet"} <= names


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["framework", "phase", "nodes", "mean_s", "base_nodes", "speedup"]
    rows = df.collect()
    assert len(rows) > 0
    assert all(r.speedup > 0 for r in rows)
