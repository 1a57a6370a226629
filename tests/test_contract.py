"""Driver contract: entry() runs, and registered queries equal their DuckDB oracles (sf0.001)."""

import math

import duckdb
import pytest
from conftest import SF0001

import __spark_entry__ as E
from hirelake.sources.tables import TABLES

CHECKED = ["filter_breakdown", "filter_partial", "keepfirst_rows", "dedup_groups", "dedup_unique",
           "ingest_postings", "index_summary", "tracker_state", "quality_conformance", "pages_links",
           "filter_relevance"]


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["filter_name", "passed", "failed", "missing_data"]
    assert df.count() == 8


def test_every_query_has_a_callable_and_oracles_are_a_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == _rows(res.fetchall(), cols)
