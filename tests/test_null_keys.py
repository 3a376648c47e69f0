"""A NULL key is a key of its own in scans, joins and comparisons, across any number of cells."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lagledger.operators import scan as sc
from lagledger.operators import statistics as st
from lagledger.operators.nearest import nearest_join, point_in_interval
from lagledger.operators.scan import Slicing, framed, given_keys, plain_keys, row_framed, runs, scan

KEYS = [None, 7, 8]
NARROW = Slicing(width=10)
CUT = Slicing(width=10, max_rows=2, parts=3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(k, None if r.random() < 0.1 else f"g{r.randint(0, 1)}", t, r.choice([None, t * 2])) for k in KEYS for t in sorted(r.sample(range(200), 40))]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k int, g string, t long, v long").repartition(5)


@pytest.mark.parametrize("slicing", [NARROW, CUT])
@pytest.mark.parametrize("keys", [["k"], ["k", "g"]])
def test_scan(df, rows, slicing, keys):
    got = scan(
        df, keys, "t", slicing, before={"b": F.col("t")}, after={"a": F.col("t")}, last_seen={"l": F.col("v")}, next_seen={"x": F.col("v")},
        running={"s": F.col("t")}, running_max={"m": F.col("t")}, index="i",
    ).collect()
    by = defaultdict(list)
    for k, g, t, v in sorted(rows, key=lambda r: r[2]):
        by[(k, g)[: len(keys)]].append((t, v))
    want = set()
    for key, seq in by.items():
        for i, (t, v) in enumerate(seq):
            seen = [y for _, y in seq[: i + 1] if y is not None]
            later = [y for _, y in seq[i:] if y is not None]
            want.add((*key, t, seq[i - 1][0] if i else None, seq[i + 1][0] if i + 1 < len(seq) else None, seen[-1] if seen else None,
                      later[0] if later else None, sum(u for u, _ in seq[: i + 1]), seq[i - 1][0] if i else None, i))
    assert {(*[r[k] for k in keys], r["t"], r["b"], r["a"], r["l"], r["x"], r["s"], r["m"], r["i"]) for r in got} == want


@pytest.mark.parametrize("slicing", [NARROW, CUT])
def test_frames_and_runs(df, rows, slicing):
    near = {(r["k"], r["t"]): r["n"] for r in framed(df, ["k"], "t", slicing, {"n": ("count(1)", -15, 15)}).collect()}
    assert near == {(k, t): sum(k == j and abs(u - t) <= 15 for j, _, u, _ in rows) for k, _, t, _ in rows}
    three = {(r["k"], r["t"]): r["n"] for r in row_framed(df, ["k"], "t", slicing, {"n": (F.sum("t"), -1, 1)}, block=7).collect()}
    for key in KEYS:
        times = sorted(t for k, _, t, _ in rows if k == key)
        assert all(three[key, t] == sum(times[max(0, i - 1) : i + 2]) for i, t in enumerate(times))
    numbered = runs(df, ["k"], "t", slicing, F.col("g")).collect()
    assert {r["k"] for r in numbered} == set(KEYS) and len(numbered) == len(rows)


@pytest.mark.parametrize("slicing", [NARROW, CUT])
@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
def test_nearest_join(spark, df, rows, slicing, direction):
    points = [(k, p) for k in [*KEYS, 9] for p in (0, 33, 77, 140, 205)]
    left = spark.createDataFrame(points, "k int, t long")
    got = nearest_join(left, df.select("k", "t", F.col("t").alias("id")), ["k"], "t", slicing, tie="id", direction=direction).collect()
    for r in got:
        times = [t for k, _, t, _ in rows if k == r["k"] and (direction == "nearest" or (t <= r["t"] if direction == "backward" else t >= r["t"]))]
        want = min(times, key=lambda t: (abs(t - r["t"]), t)) if times else None
        assert (r["match"]["t"] if r["match"] else None) == want
    assert len(got) == len(points)


def test_point_in_interval(spark):
    points = spark.createDataFrame([(None, 5), (None, 55), (None, 95), (7, 55)], "k int, t long")
    intervals = spark.createDataFrame([(None, 1, 0, 60), (None, 2, 60, 90), (7, 3, 50, 56)], "k int, id long, start long, end long")
    got = point_in_interval(points, intervals, ["k"], "t", "start", "end", NARROW, tie="id").collect()
    assert {(r["k"], r["t"], r["interval"]["id"] if r["interval"] else None) for r in got} == {(None, 5, 1), (None, 55, 1), (None, 95, None), (7, 55, 3)}


def test_keys_come_back(spark):
    df = spark.createDataFrame([(None, None, None, [1]), (1, "a", True, None)], "i int, s string, b boolean, a array<int>")
    named, own = plain_keys(df, df.columns)
    back = named.select(*own).select(*given_keys(df.columns, own)).collect()
    assert sorted(map(str, back)) == sorted(map(str, df.collect()))
    assert not any(named.schema[c].nullable for c in own)
    assert sc.plain_keys(spark.range(1), ["id"])[1] == ["id"]


def test_comparisons_keep_a_null_stratum(spark):
    """The NULL stratum gives what the same rows give under a name."""
    r = random.Random(1)
    rows = [(g, r.gauss(1 if g == "candidate" else 0, 1), 1) for g in ("candidate",) * 9 + ("control",) * 8]
    named = [(s, *x) for s in ("a", "b") for x in rows]
    some = [(None if s == "a" else s, *x) for s, *x in named]
    schema = "s string, grp string, v double, event_count int"
    for compute in (
        lambda d: st.cliffs_delta(d, ["s"], "grp", "v"),
        lambda d: st.label_permutation(d, ["s"], "grp", "v", iterations=50, seed=1),
        lambda d: st.exact_median_permutation(d, ["s"], "grp", "v"),
        lambda d: st.compare_groups(d, ["s"], value="v", margin_ms=0.5, iterations=50, permutations=50, draws="hash").drop("bootstrap_ci95"),
        lambda d: st.compare_metrics(d, ["s"], ["v"], iterations=50, seed=3).drop("ci_low", "ci_high", "bootstrap_share_above_zero"),
        lambda d: st.bootstrap_median_difference(d, ["s"], "grp", "v", iterations=50, seed=1, draws="hash"),
    ):
        want = {tuple(None if x == "a" else x for x in r) for r in compute(spark.createDataFrame(named, schema)).collect()}
        got = compute(spark.createDataFrame(some, schema))
        assert set(map(tuple, got.collect())) == want and got.columns[0] == "s" and len(want) == 2
    drawn = st.bootstrap_median_difference(spark.createDataFrame(some, schema), ["s"], "grp", "v", iterations=200, seed=1).collect()
    assert {r["s"] for r in drawn} == {None, "b"}
