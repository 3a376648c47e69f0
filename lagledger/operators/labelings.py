"""Counting the labelings of a group whose difference of medians reaches a bar, by pairs of central ranks.

Of n sorted values k are labelled candidate, the others control. A median is the mean of two central ranks of its side (one
rank, taken twice, where the side is odd). Between two neighbouring ranks of one side lie only values of the other, so
few arrangements of the four central ranks exist, and each one's labelings are a product of binomials:

* ``apart``: both central ranks of one side lie below both of the other;
* ``around``: the central ranks of one side enclose those of the other, which then stand in the middle of all values;
* ``crossed``: they alternate (both sides even), and the two inner ones stand in the middle.

For given inner ranks the outermost one only has to reach a limit, and the binomials above a limit sum to one binomial.
So n^3 / 6 steps at most remain, less in a window of likely ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import comb, lgamma

import numpy as np

LEFT_OUT = 1e-40  # share of all labelings below which a term is left out, in groups above WHOLE rows
WHOLE = 400


class Whole:
    """Whole numbers of any size."""

    zero = 0

    def choose(self, n, k):
        return np.array([comb(int(a), int(b)) if 0 <= b <= a else 0 for a, b in zip(*np.broadcast_arrays(n, k), strict=True)], object)

    def times(self, a, b):
        return a * b

    def less(self, a, b):
        return a - b

    def sum(self, terms):
        return sum(terms.ravel().tolist())

    def likely(self, terms):
        return np.ones(len(terms), bool)


class Shares:
    """Logarithms of parts of all C(n, k) labelings; sums are shares."""

    zero = 0.0

    def __init__(self, n: int, k: int) -> None:
        self.logs = np.array([lgamma(i + 1) for i in range(n + 2)])
        self.all = self.logs[n] - self.logs[k] - self.logs[n - k]
        self.least = np.log(LEFT_OUT) + self.all if n > WHOLE else -np.inf

    def choose(self, n, k):
        n, k = np.broadcast_arrays(np.asarray(n), np.asarray(k))
        fits = (k >= 0) & (k <= n) & (n >= 0)
        a, b = np.where(fits, n, 0), np.where(fits, k, 0)
        return np.where(fits, self.logs[a] - self.logs[b] - self.logs[a - b], -np.inf)

    def times(self, a, b):
        return a + b

    def less(self, a, b):
        """log(e^a - e^b) for b <= a; nothing where they are equal."""
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.log1p(-np.exp(np.minimum(b - a, 0.0)))
        return np.where(np.isneginf(a), -np.inf, a + gap)

    def sum(self, terms):
        return float(np.exp(terms - self.all).sum())

    def likely(self, terms):
        return terms >= self.least


@dataclass(frozen=True)
class Labelings:
    """``v``: sorted values; ``k`` of them are candidates. The difference is candidate median minus control median."""

    v: np.ndarray
    k: int
    bar: float
    numbers: Whole | Shares

    def _limit(self, x: np.ndarray, side: str = "left") -> np.ndarray:
        """First rank whose value is not below x (or, from the right, above x)."""
        return np.searchsorted(self.v, x, side)

    def apart(self, first: int, last: int, candidates_above: bool, at_all: bool = False) -> int | float:
        """Labelings with one side's central ranks below the other's, the lower side's upper rank in [first, last).

        ``at_all`` counts them whatever the difference.
        """
        n, v, num = len(self.v), self.v, self.numbers
        low_size, high_size = (n - self.k, self.k) if candidates_above else (self.k, n - self.k)
        low_even, high_even = low_size % 2 == 0, high_size % 2 == 0
        below, above = (low_size - 1) // 2, (high_size - 1) // 2  # before the lower, behind the upper central rank
        total = num.zero
        for p2 in range(first, min(last, n)):
            p1 = np.arange(below, p2) if low_even else np.array([p2])
            start = num.choose(p1, below)
            q1 = np.arange(p2 + 1, n)
            middle = num.choose(q1 - p2 - 1, above + below + low_even - p2 + np.zeros(len(q1), np.int64))
            if not len(p1) or not len(q1):
                continue
            # rows: first rank above; columns: lower of the two ranks below
            behind = num.choose(n - q1 - 1, above + 1 if high_even else above)
            rows = num.likely(num.times(middle, behind) + (num.choose(np.array([p2]), below)[0] if isinstance(num, Shares) else 0))
            q1, middle = q1[rows], middle[rows]
            if not len(q1):
                continue
            columns = num.likely(start + num.times(middle, behind[rows]).max()) if isinstance(num, Shares) else np.ones(len(p1), bool)
            p1, start = p1[columns], start[columns]
            if not len(p1):
                continue
            want = 2 * self.bar if candidates_above else -2 * self.bar
            low_sum, high = v[p1][None, :] + v[p2], v[q1][:, None]
            shape = (len(q1), len(p1))
            if high_even:
                lead = np.broadcast_to((q1 + 1)[:, None], shape)
                if at_all:
                    tail = num.choose((n - lead).ravel(), above + 1).reshape(shape)
                elif candidates_above:  # the upper rank above must reach the limit
                    reach = np.maximum(lead, self._limit(want + low_sum - high))
                    tail = num.choose((n - reach).ravel(), above + 1).reshape(shape)
                else:  # it must not exceed it
                    reach = np.maximum(lead, self._limit(want + low_sum - high, "right"))
                    tail = num.less(num.choose((n - lead).ravel(), above + 1), num.choose((n - reach).ravel(), above + 1)).reshape(shape)
                terms = num.times(num.times(middle[:, None], start[None, :]), tail)
            else:
                difference = 2 * high - low_sum
                good = np.ones(shape, bool) if at_all else difference >= want if candidates_above else difference <= want
                terms = num.times(num.times(middle[:, None], start[None, :]), num.choose(n - q1 - 1, above)[:, None])[good]
            total += num.sum(terms)
        return total

    def together(self, at_all: bool = False) -> int | float:
        """Labelings whose central ranks enclose each other or alternate."""
        n, k, v, num = len(self.v), self.k, self.v, self.numbers
        a, b = (k - 1) // 2, (n - k - 1) // 2
        even_k, even_m = k % 2 == 0, (n - k) % 2 == 0
        total = num.zero

        def outer(below: int, above: int, inner: tuple[int, int], least: float | None, most: float | None, sign: int) -> int | float:
            """Ranks p < inner < q, ``below`` values of p's side before p, ``above`` of q's behind q, v[p] * sign + v[q] in the limits."""
            p = np.arange(below, inner[0])
            start, lead = num.choose(p, below), np.full(len(p), inner[1] + 1)
            whole = num.choose(n - lead, above + 1)
            if least is not None:
                whole = num.choose(n - np.maximum(lead, self._limit(least - sign * v[p])), above + 1)
            elif most is not None:
                whole = num.less(whole, num.choose(n - np.maximum(lead, self._limit(most - sign * v[p], "right")), above + 1))
            return num.sum(num.times(start, whole)) if len(p) else num.zero

        c = a + b + 1
        free = (None, None)
        if even_k and even_m:
            d = c + 1
            inside = v[c] + v[d]
            total += outer(a, a, (c, d), *(free if at_all else (inside + 2 * self.bar, None)), 1)  # candidates around controls
            total += outer(b, b, (c, d), *(free if at_all else (None, inside - 2 * self.bar)), 1)  # controls around candidates
            total += outer(a, b, (c, d), *(free if at_all else (None, v[d] - v[c] - 2 * self.bar)), -1)  # candidate, control, candidate, control
            total += outer(b, a, (c, d), *(free if at_all else (2 * self.bar + v[d] - v[c], None)), -1)  # control first
        elif even_k:  # one control rank inside
            total += outer(a, a, (c, c), *(free if at_all else (2 * v[c] + 2 * self.bar, None)), 1)
        elif even_m:
            total += outer(b, b, (c, c), *(free if at_all else (None, 2 * v[c] - 2 * self.bar)), 1)
        return total


def bar_of(observed: float) -> float:
    return observed - 1e-12 * max(1.0, abs(observed))


def tail_of_labelings(v: Sequence[float], k: int, observed: float) -> tuple[int, int]:
    """(labelings with median difference >= observed, all labelings) for sorted values, as whole numbers."""
    count = Labelings(np.asarray(v, np.float64), k, bar_of(observed), Whole())
    n = len(v)
    tail = count.apart(0, n, True) + count.apart(0, n, False) + count.together()
    return tail, comb(n, k)


def share_of_labelings(v: np.ndarray, k: int, observed: float, first: int, last: int) -> float:
    """The part of :func:`tail_of_labelings`, as a share of all, whose lower side's upper rank lies in [first, last).

    Arrangements that are not apart belong to the block that starts at 0. The parts of all blocks add up.
    """
    count = Labelings(v, k, bar_of(observed), Shares(len(v), k))
    return count.apart(first, last, True) + count.apart(first, last, False) + (count.together() if first == 0 else 0.0)
