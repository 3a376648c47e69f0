"""Hot keys take the second path; results must equal a plain loop on one machine."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagledger.operators import nearest as nj
from lagledger.operators import quantiles as qt
from lagledger.operators import scan as sc
from lagledger.operators import sequence as seq
from lagledger.operators import statistics as st

COLD = sc.Slicing(width=50)
HOT = sc.Slicing(width=50, max_rows=5, parts=4)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    # One key holds nearly all rows, most of them inside one cell.
    t = np.concatenate([rng.integers(0, 40, 120), rng.integers(0, 1000, 60), rng.integers(0, 1000, 20)])
    k = np.concatenate([np.ones(180, int), np.full(20, 2)])
    return pd.DataFrame({"k": k, "t": t, "id": np.arange(200), "v": rng.integers(0, 9, 200).astype(float)})


@pytest.mark.parametrize("slicing", [COLD, HOT], ids=["cold", "hot"])
def test_scan_equals_plain_window(spark, rows, slicing):
    df = spark.createDataFrame(rows)
    got = sc.scan(
        df, ["k"], "t", slicing, ties=["id"], before={"b": F.col("v")}, after={"a": F.col("v")},
        last_seen={"ls": F.when(F.col("v") > 6, F.col("v"))}, next_seen={"ns": F.when(F.col("v") > 6, F.col("v"))},
        running={"s": F.col("v")}, running_max={"m": F.col("v")}, index="i",
    ).toPandas().sort_values("id").reset_index(drop=True)
    p = rows.sort_values(["k", "t", "id"])
    g = p.groupby("k")["v"]
    big = p["v"].where(p["v"] > 6)
    want = pd.DataFrame(
        {
            "id": p["id"], "b": g.shift(1), "a": g.shift(-1), "s": g.cumsum(), "i": p.groupby("k").cumcount(),
            "m": g.cummax().groupby(p["k"]).shift(1), "ls": big.groupby(p["k"]).ffill(), "ns": big.groupby(p["k"]).bfill(),
        }
    ).sort_values("id").reset_index(drop=True)
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


@pytest.mark.parametrize("slicing", [COLD, HOT], ids=["cold", "hot"])
def test_runs_and_frames(spark, rows, slicing):
    df = spark.createDataFrame(rows)
    got = sc.runs(df, ["k"], "t", slicing, F.col("v") > 4, ties=["id"]).toPandas().sort_values("id")
    p = rows.sort_values(["k", "t", "id"])
    flag = p["v"] > 4
    start = (flag != flag.groupby(p["k"]).shift(1)).astype(int)
    want = start.groupby(p["k"]).cumsum().loc[rows.index]
    assert (got["run_id"].to_numpy() == want.sort_index().to_numpy()).all()
    framed = sc.framed(df, ["k"], "t", slicing, {"m": ("percentile(v, 0.5)", -30, 7), "n": ("count(v)", -30, 7)}).toPandas().sort_values("id")
    for r in framed.itertuples():
        near = rows[(rows.k == r.k) & (rows.t >= r.t - 30) & (rows.t <= r.t + 7)]["v"]
        assert r.n == len(near) and r.m == np.median(near)


@pytest.mark.parametrize("slicing", [COLD, HOT], ids=["cold", "hot"])
@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_nearest_join(spark, rows, slicing, direction, strict):
    left, right = rows[rows.id % 2 == 0], rows[rows.id % 2 == 1]
    out = nj.nearest_join(
        spark.createDataFrame(left), spark.createDataFrame(right.rename(columns={"id": "rid"})[["k", "t", "rid"]]), ["k"], "t", slicing,
        tie="rid", direction=direction, strict=strict,
    ).select("id", "match.rid").toPandas().set_index("id")["rid"]
    for r in left.itertuples():
        c = right[right.k == r.k]
        c = c[c.t <= r.t] if direction == "backward" else c[c.t >= r.t] if direction == "forward" else c
        c = c[c.t != r.t] if strict else c
        if c.empty:
            assert pd.isna(out[r.id])
            continue
        best = min(c.itertuples(), key=lambda x: (abs(x.t - r.t), x.t, x.id))
        assert out[r.id] == best.id


@pytest.mark.parametrize("limit", [None, 10])
def test_exact_quantiles(spark, rows, limit):
    df = spark.createDataFrame(rows)
    got = qt.quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, extra=[F.count("v").alias("n")], max_rows=limit).toPandas()
    for r in got.itertuples():
        v = rows[rows.k == r.k]["v"]
        assert r.n == len(v) and np.allclose([r.a, r.b, r.c], np.percentile(v, [5, 50, 95]))


def test_bracketed_quantiles_of_many_values(spark):
    v = np.random.default_rng(0).normal(size=60_000)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v}))
    r = qt.quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.9}, max_rows=1000).collect()[0]
    assert np.allclose([r.a, r.b, r.c], np.percentile(v, [5, 50, 90]), atol=1e-12)


def test_global_index_is_dense(spark, rows):
    got = sc.global_index(spark.createDataFrame(rows), "t", HOT, ties=["id"]).toPandas().sort_values(["t", "id"])
    assert got["position"].tolist() == list(range(200))


def test_centered_median_blocks(spark, rows):
    df = spark.createDataFrame(rows[rows.k == 1])
    out = sc.row_framed(df, ["k"], "t", HOT, {"m": (F.percentile("v", 0.5), -2, 2)}, ties=["id"], block=7).toPandas()
    v = rows[rows.k == 1].sort_values(["t", "id"])["v"].to_numpy()
    want = [np.median(v[max(0, i - 2) : i + 3]) for i in range(len(v))]
    assert out.sort_values(["t", "id"])["m"].tolist() == want


def test_exact_permutation_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    for n, k in [(6, 3), (7, 3), (7, 4), (8, 4), (9, 2), (8, 1)]:
        v = sorted(rng.integers(0, 5, n).tolist())
        for obs in (-1.0, 0.0, 0.5, 2.0):
            stats = [
                np.median([v[i] for i in c]) - np.median([v[i] for i in range(n) if i not in c]) for c in itertools.combinations(range(n), k)
            ]
            assert st.tail_of_labelings(v, k, obs) == (sum(s >= obs - 1e-12 for s in stats), len(stats))


def test_cliffs_delta_and_groups_above_130_rows(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"s": "x", "grp": ["candidate"] * 80 + ["control"] * 70, "v": rng.integers(0, 20, 150).astype(float)})
    df = spark.createDataFrame(p)
    r = st.cliffs_delta(df, ["s"], "grp", "v").collect()[0]
    a, b = p[p.grp == "candidate"].v.to_numpy(), p[p.grp == "control"].v.to_numpy()
    d = a[:, None] - b[None, :]
    assert abs(r["cliffs_delta"] - (2 * ((d > 0).mean() + 0.5 * (d == 0).mean()) - 1)) < 1e-12
    counted = st.exact_median_permutation(df, ["s"], "grp", "v").collect()[0]
    assert counted["method"] == "exact" and counted["total"] is None and 0 < counted["exact_p"] < 1
    drawn = st.label_permutation(df, ["s"], "grp", "v", iterations=100_000, seed=3).collect()[0]
    assert drawn["total"] == 100_000 and abs(drawn["permutation_p"] - counted["exact_p"]) < 0.006
    large = spark.createDataFrame(pd.DataFrame({"s": "x", "grp": ["candidate"] * 201 + ["control"] * 250, "v": rng.normal(size=451)}))
    sampled = st.exact_median_permutation(large, ["s"], "grp", "v", most_exact=400).collect()[0]
    assert sampled["method"] == "sampled" and sampled["total"] == 100_000 and 0 <= sampled["exact_p"] <= 1


@pytest.mark.parametrize("n,m", [(7, 9), (8, 5), (6, 12), (1, 30)])
def test_rank_draws_have_the_distribution_of_row_draws(spark, n, m):
    """Resamples and labelings whose middle ranks are drawn against ones made row by row."""
    rng = np.random.default_rng(n)
    a, b = rng.normal(1, 1, n), rng.normal(0, 1, m)
    df = spark.createDataFrame(pd.DataFrame({"s": [None] * (n + m), "grp": ["candidate"] * n + ["control"] * m, "v": np.concatenate((a, b))}), "s string, grp string, v double")
    got = st.bootstrap_median_difference(df.fillna("k"), ["s"], "grp", "v", iterations=40_000, seed=5).collect()[0]
    d = np.median(rng.choice(a, (40_000, n)), axis=1) - np.median(rng.choice(b, (40_000, m)), axis=1)
    assert abs(got["bootstrap_share_above_zero"] - (d > 0).mean()) < 0.015
    low, high = np.quantile(d, [0.02, 0.03]), np.quantile(d, [0.97, 0.98])
    assert low[0] <= got["ci_low"] <= low[1] and high[0] <= got["ci_high"] <= high[1]
    pool = st._ranked_pool(df.fillna("k"), ["s"], "grp", "v")
    hits, total = st._random_labelings(pool, ["s"], 40_000, 9).select("hits", "total").collect()[0]
    both, observed = np.concatenate((a, b)), np.median(a) - np.median(b)
    mixed = rng.permuted(np.broadcast_to(both, (40_000, n + m)), axis=1)
    share = (np.median(mixed[:, :n], axis=1) - np.median(mixed[:, n:], axis=1) >= observed - 1e-12).mean()
    assert total == 40_000 and abs(hits / total - share) < 0.012


def test_runs_keep_rows_without_key_or_time(spark):
    from lagledger.operators.scan import Slicing, framed, runs

    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 30, "y"), ("a", None, "x"), (None, 1, "x"), (None, 25, "y"), (None, 26, "y")]
    df = spark.createDataFrame(rows, "k string, t long, l string")
    got = sorted((r["k"] or "", -1 if r["t"] is None else r["t"], r["run_id"]) for r in runs(df, ["k"], "t", Slicing(width=10), F.col("l")).collect())
    assert got == [("", 1, 1), ("", 25, 2), ("", 26, 2), ("a", -1, 1), ("a", 1, 1), ("a", 2, 1), ("a", 30, 2)]
    assert framed(df, ["k"], "t", Slicing(width=10), {"n": ("count(1)", -1, 0)}).count() == len(rows)


def test_deviation_of_a_null_key(spark):
    from lagledger.operators.quantiles import median_and_mad

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 8.0), ("a", 2.0)], "k string, v double")
    assert {(r["k"], r["median"], r["mad"]) for r in median_and_mad(df, ["k"], "v").collect()} == {(None, 3.0, 2.0), ("a", 2.0, 0.0)}


def test_partition_count_does_not_matter(spark, rows):
    df = spark.createDataFrame(rows)
    a = seq.jump_flags(df.repartition(1), ["k"], "t", "v", 0.15, HOT, ties=["id"]).select("id", "jump").collect()
    b = seq.jump_flags(df.repartition(7), ["k"], "t", "v", 0.15, COLD, ties=["id"]).select("id", "jump").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("fold_rows,max_rows", [(10_000, 10_000), (3, 10_000), (3, 40)])
def test_greedy_choices_agree_on_every_path(spark, fold_rows, max_rows):
    from lagledger.operators.release import cluster_events, min_separation

    rng = np.random.default_rng(8)
    t = np.unique(rng.integers(0, 4000, 260)).astype(float)
    p = pd.DataFrame({"k": "a", "t": t, "s": rng.integers(0, 12, len(t)).astype(float), "id": np.arange(len(t))})
    order = p.sort_values(["s", "t"], ascending=[False, True])
    kept, home = [], {}
    for x in order.itertuples():
        if all(abs(y.t - x.t) >= 20 for y in kept):
            kept.append(x)
    leaders = []
    for x in order.itertuples():
        own = next((y for y in leaders if abs(y.t - x.t) <= 20), x)
        if own is x:
            leaders.append(x)
        home[x.t] = (own.t, own.s)
    df = spark.createDataFrame(p)
    got = min_separation(df, ["k"], "t", "s", "id", 20.0, COLD, max_rows=max_rows, fold_rows=fold_rows)
    assert sorted(r["id"] for r in got.collect()) == sorted(y.id for y in kept)
    got = cluster_events(df, ["k"], "t", "s", 20.0, COLD, max_rows=max_rows, fold_rows=fold_rows)
    assert {r["t"]: (r["leader_t"], r["leader_score"]) for r in got.collect()} == home


def test_a_long_ramp_is_decided_in_one_pass(spark):
    from lagledger.operators.release import min_separation

    df = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"), F.col("id").cast("double").alias("s"), "id")
    got = min_separation(df, ["k"], "t", "s", "id", 10.0, sc.Slicing(width=1e4))
    assert got.count() == 10_000


def test_rows_of_a_shuffle_bound_its_tasks(spark):
    """The session's number of partitions did not look at the rows: tasks and their memory grew with the table."""
    from lagledger.operators.scan import Slicing, scan
    from lagledger.session import tasks_for

    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 0) is None and tasks_for(spark, fixed * 1_000_000) is None and tasks_for(spark, 216_000_000) == 216
    df = spark.range(0, 5_000, 1, 2).selectExpr("id % 40 AS k", "id AS t")
    more = scan(df, ["k"], "t", Slicing(width=500, tasks=30), index="i")
    assert more.rdd.getNumPartitions() == 30
    assert sorted(more.collect()) == sorted(scan(df, ["k"], "t", Slicing(width=500), index="i").collect())
