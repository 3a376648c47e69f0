"""Labelings counted by pairs of central ranks against a list of all of them."""

import itertools
import random
from math import comb

import numpy as np
import pytest

from lagledger.operators import statistics as st
from lagledger.operators.labelings import Labelings, Whole, bar_of, share_of_labelings, tail_of_labelings


def listed(v, k, observed):
    tail = total = 0
    for own in itertools.combinations(range(len(v)), k):
        rest = [v[i] for i in range(len(v)) if i not in own]
        total += 1
        tail += np.median([v[i] for i in own]) - np.median(rest) >= bar_of(observed)
    return tail, total


@pytest.mark.parametrize("seed", range(8))
def test_counts_equal_the_list(seed):
    """All parities, with and without ties, bars on both sides of zero and on values that occur."""
    r = random.Random(seed)
    for _ in range(40):
        n = r.randint(2, 9)
        k = r.randint(1, n - 1)
        v = sorted(r.choice([r.randint(0, 6), round(r.random(), 2)]) for _ in range(n))
        observed = r.choice([0.0, 0.5, r.uniform(-4, 4), float(r.randint(-3, 3))])
        tail, total = listed(v, k, observed)
        assert tail_of_labelings(v, k, observed) == (tail, total)
        assert share_of_labelings(np.array(v, float), k, observed, 0, n) == pytest.approx(tail / total, abs=1e-12)
        parts = Labelings(np.array(v, float), k, 0.0, Whole())
        assert parts.apart(0, n, True, True) + parts.apart(0, n, False, True) + parts.together(True) == comb(n, k)


@pytest.mark.parametrize("n,k", [(130, 65), (129, 64), (131, 65), (301, 150), (450, 200)])
def test_shares_of_blocks_add_up_to_whole_numbers(n, k):
    v = np.sort(np.random.default_rng(n).normal(size=n))
    shares = sum(share_of_labelings(v, k, 0.2, f, f + 50) for f in range(0, n, 50))
    if n <= 131:
        tail, total = tail_of_labelings(v.tolist(), k, 0.2)
        assert shares == pytest.approx(tail / total, rel=1e-10)
    assert sum(share_of_labelings(v, k, -100.0, f, f + 50) for f in range(0, n, 50)) == pytest.approx(1.0, rel=1e-10)
    assert shares + sum(share_of_labelings(-v[::-1], k, -0.2, f, f + 50) for f in range(0, n, 50)) == pytest.approx(1.0, rel=1e-9)


def test_groups_of_all_sizes(spark):
    r = np.random.default_rng(7)
    sizes = {"few": (6, 5), "whole": (60, 70), "many": (300, 260), "most": (5_000, 5_000), "above": (5_001, 5_000)}
    rows = [(s, g, float(x)) for s, (c, m) in sizes.items() for g, size, shift in (("candidate", c, 0.02), ("control", m, 0.0)) for x in r.normal(shift, 1, size)]
    df = spark.createDataFrame(rows, "s string, grp string, v double")
    got = {x["s"]: x for x in st.exact_median_permutation(df, ["s"], "grp", "v", iterations=20_000).collect()}
    assert {s: x["method"] for s, x in got.items()} == {**dict.fromkeys(sizes, "exact"), "above": "sampled"}
    for s, (c, m) in sizes.items():
        v = {g: [x for t, h, x in rows if t == s and h == g] for g in ("candidate", "control")}
        observed = float(np.median(v["candidate"]) - np.median(v["control"]))
        if s == "few":
            assert (int(got[s]["tail"]), int(got[s]["total"])) == listed(sorted(v["candidate"] + v["control"]), c, observed)
        elif s == "whole":
            assert int(got[s]["total"]) == comb(c + m, c)
        else:
            assert got[s]["tail"] is None or s == "above"
        drawn = st.exact_median_permutation(df.filter(df.s == s), ["s"], "grp", "v", iterations=20_000, most_exact=0).collect()[0]
        assert drawn["method"] == "sampled" and got[s]["exact_p"] == pytest.approx(drawn["exact_p"], abs=0.02)
