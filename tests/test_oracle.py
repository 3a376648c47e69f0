"""Every query with an SQL twin must give the same rows, columns and values in DuckDB."""

import decimal
import glob
import math
import os

import pytest

import __spark_entry__ as entry_point

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None if isinstance(v, float) and math.isnan(v) else float(v) + 0.0
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()]
    if name not in SQL:
        return
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in result.fetchall()]
    assert ordered(rows) == ordered(expected)


def test_entry_has_a_stable_schema(spark):
    assert entry_point.entry(spark).columns == [
        "speaker", "grp", "epoch_id", "event_count", "median_lag_ms", "fraction_over_margin", "mad_lag_ms"
    ]


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
