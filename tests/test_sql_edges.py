"""Queries and their SQL state one rule: odd values of events give the same rows."""

import datetime as dt

import pytest
from test_oracle import QUERIES, SQL, ordered, plain

duckdb = pytest.importorskip("duckdb")
VALUES = [0.0, 20.0, 19.9999995, 19.9, 0.0, 0.0, 1e-12, 5.0, -3.0, 5.0, None, 5.0, 5.5, 6.5, float("inf"), 30.0, -0.0, 0.0, 2e-10, 1e-10, 40.0, 40.0]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(hours=9 * k), u, "view", v, None) for u in (1, 2, 3) for k, v in enumerate(VALUES[u - 1 :], 100 * u)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["p21_scope_end", "w1_jump_flags"])
def test_same_rule(spark, folder, name):
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert sorted(names) == sorted(df.columns)
    assert ordered(rows) == ordered([tuple(map(plain, r)) for r in result.fetchall()])
