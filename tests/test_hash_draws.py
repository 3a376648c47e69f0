"""Hash draws by middle ranks in brackets give what every row of every draw gives, in tasks of equal size."""

import random
from statistics import median

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lagledger.operators import statistics as st

B = 20


def mixed(x):
    for _ in range(2):
        x = (((x >> 16) ^ x) * 73244475) & st.MASK
    return (x >> 16) ^ x


def hashed(seed, b, slot):
    return mixed(mixed((b * 31 + seed) & st.MASK) ^ mixed(slot))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    return [(s, g, round(r.gauss(m, 1), 2)) for s in ("x", None) for g, m, n in (("candidate", 0.1, 61), ("control", 0.0, 240), (None, 5.0, 3)) for _ in range(n)]


@pytest.mark.parametrize("spread", [st.SPREAD, 0.01])  # the small one leaves most brackets without the places
@pytest.mark.parametrize("block", [st.RANK_BLOCK, 7])
def test_draws_agree_with_all_rows(spark, rows, monkeypatch, spread, block):
    monkeypatch.setattr(st, "SPREAD", spread)
    monkeypatch.setattr(st, "RANK_BLOCK", block)
    df = spark.createDataFrame(rows, "s string, g string, v double")
    boot = {r["s"]: r for r in st.bootstrap_median_difference(df, ["s"], "g", "v", iterations=B, seed=5, draws="hash").collect()}
    two = df.filter("g IS NOT NULL")
    perm = {r["s"]: r for r in st.label_permutation(two, ["s"], "g", "v", iterations=B, seed=6, draws="hash").collect()}
    assert set(boot) == set(perm) == {"x", None}
    for s in boot:
        mine, theirs = (sorted(v for t, h, v in rows if t == s and h == g) for g in ("candidate", "control"))
        both = sorted(mine + theirs)
        resampled = lambda v, b: median(v[hashed(5, b, k) * len(v) // (1 << 32)] for k in range(len(v)))
        gaps = [resampled(mine, b) - resampled(theirs, b) for b in range(B)]
        assert boot[s]["bootstrap_share_above_zero"] == pytest.approx(sum(d > 0 for d in gaps) / B)
        assert boot[s]["ci_low"] == pytest.approx(sorted(gaps)[0] + 0.475 * (sorted(gaps)[1] - sorted(gaps)[0]))
        hits = 0
        for b in range(B):
            order = sorted(range(len(both)), key=lambda k: (hashed(6, b, k), k))
            chosen, rest = order[: len(mine)], order[len(mine) :]
            hits += median(both[k] for k in chosen) - median(both[k] for k in rest) >= median(mine) - median(theirs) - 1e-12
        assert (perm[s]["hits"], perm[s]["total"]) == (hits, B)


def test_draws_of_one_group_are_dealt_to_many_tasks(spark, monkeypatch):
    """One key used to draw all rows of all replicates in one task."""
    monkeypatch.setattr(st, "RANK_BLOCK", 1_000)
    sizes = spark.createDataFrame([("all", 40_000)], "s string, _n long")
    dealt = st._hashed(st._replicates(sizes, 8, 1), F.col("_n"))
    per_task = [n for n in dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(per_task) == 320_000 and len(per_task) >= 8 and max(per_task) <= 2 * 32_000


QUERIES = {
    "q2_bootstrap_median_diff": lambda df: st.bootstrap_median_difference(df, ["s"], "g", "v", iterations=B, seed=5, draws="hash"),
    "q3_label_permutation": lambda df: st.label_permutation(df, ["s"], "g", "v", iterations=B, seed=6, draws="hash"),
}


@pytest.mark.parametrize("name", QUERIES)
def test_no_task_of_a_comparison_makes_the_draws_of_a_group(spark, monkeypatch, tmp_path, name):
    """From the call to the result: every draw is made, none of the tasks makes more than its blocks."""
    folder, plain = str(tmp_path), st._slot_draw

    @F.pandas_udf("long")
    def seen(u: pd.Series) -> pd.Series:
        task = TaskContext.get()
        with open(f"{folder}/{task.stageId()}-{task.partitionId()}", "a") as out:
            out.write(f"{len(u)}\n")
        return u

    monkeypatch.setattr(st, "RANK_BLOCK", 500)
    monkeypatch.setattr(st, "BLOCKS", 4)
    monkeypatch.setattr(st, "_slot_draw", lambda stream, slot: seen(plain(stream, slot)))
    r = random.Random(12)
    rows = [("all", g, r.gauss(0, 1)) for g, n in (("candidate", 1_000), ("control", 3_000)) for _ in range(n)]
    assert len(QUERIES[name](spark.createDataFrame(rows, "s string, g string, v double")).collect()) == 1
    made = [sum(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert sum(made) >= len(rows) * B and max(made) <= 2 * 500 * 4


def test_small_groups_share_tasks(spark):
    """Tasks go by draws: 2 000 groups of 30 rows used to make 1 250 tasks of 960 draws."""
    sizes = spark.range(2_000).select(F.col("id").alias("s"), F.lit(30).cast("long").alias("_n"))
    dealt = st._hashed(st._replicates(sizes, B, 1), F.col("_n"))
    assert dealt.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.count() == 2_000 * 30 * B


def test_a_small_side_keeps_few_ranks_of_the_large_one(spark, monkeypatch):
    """The bracket of 40 candidates used to keep nearly all of 4 000 ranks of every labeling, one row each."""
    places, kept = st._places, []

    def counted(counts, *rest):
        kept.append(counts.count())
        return places(counts, *rest)

    monkeypatch.setattr(st, "_places", counted)
    r = random.Random(13)
    mine, theirs = (sorted(r.gauss(m, 1) for _ in range(n)) for m, n in ((0.1, 40), (0.0, 3_960)))
    both = sorted(mine + theirs)
    hits = 0
    for b in range(B):
        order = sorted(range(len(both)), key=lambda k: (hashed(6, b, k), k))
        chosen, rest = order[: len(mine)], order[len(mine) :]
        hits += median(both[k] for k in chosen) - median(both[k] for k in rest) >= median(mine) - median(theirs) - 1e-12
    rows = [("all", "candidate", v) for v in mine] + [("all", "control", v) for v in theirs]
    out = QUERIES["q3_label_permutation"](spark.createDataFrame(rows, "s string, g string, v double")).collect()
    assert [(x["hits"], x["total"]) for x in out] == [(hits, B)]
    assert kept and max(kept) <= 10_000
