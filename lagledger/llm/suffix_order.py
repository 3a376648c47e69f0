"""Difference-cover ordering of the suffixes of one text, to a given depth, with matrices instead of loops."""

from __future__ import annotations

import numpy as np

BITS = 21  # of a symbol or a name: three of them are one sortable number
MOST = 3 * (1 << (BITS - 1)) - 8  # symbols; two thirds of them get names


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All start positions, ordered by their next ``depth`` symbols (positive numbers); equal ones in any order.

    Positions 1 and 2 modulo 3 are the sample. Their triples are sorted and named; while a name stands for fewer than
    ``depth`` symbols and names repeat, the sequence of names is ordered in the same way, to a third of the depth. The
    remaining positions are their first symbol and a sampled position, so they are sorted by that pair and merged: with
    the sample's first class by one symbol and a rank, with its second class by two symbols and a rank.
    """
    n = len(symbols)
    if n > MOST:
        raise ValueError(f"at most {MOST} symbols are ordered at once")
    s = np.concatenate((symbols, np.zeros(3, np.int64))).astype(np.uint64)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    up = np.uint64(BITS)
    triples, names = np.unique(s[sample] << (up + up) | s[sample + 1] << up | s[sample + 2], return_inverse=True)
    if depth > 3 and len(triples) < len(sample):
        ranks = np.empty(len(sample), np.int64)
        ranks[suffix_order(names.astype(np.int64) + 1, -(-depth // 3))] = np.arange(1, len(sample) + 1)
    else:
        ranks = names.astype(np.int64) + 1
    rank = np.zeros(n + 3, np.uint64)
    rank[sample] = ranks.astype(np.uint64)
    ordered = sample[np.argsort(ranks, kind="stable")]
    ordered = ordered[ordered < n]

    more = np.uint64(BITS + 1)

    def pair(at: np.ndarray) -> np.ndarray:
        return s[at] << more | rank[at + 1]

    def with_two(at: np.ndarray) -> np.ndarray:
        return s[at] << (up + more) | s[at + 1] << more | rank[at + 2]

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(pair(rest), kind="stable")]
    before = np.searchsorted(np.sort(pair(one[one < n])), pair(rest)) + np.searchsorted(np.sort(with_two(two)), with_two(rest))
    places = np.arange(len(rest)) + np.maximum.accumulate(before) if len(rest) else np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    sampled = np.ones(n, bool)
    sampled[places] = False
    out[places] = rest
    out[sampled] = ordered
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which ``starts`` (true or false per byte of ``text``) begin ``width`` bytes that also begin at another one.

    Starts with equal next bytes are neighbours in the order of the suffixes, so each is compared with the next only.
    """
    out = np.zeros(len(text), bool)
    if np.count_nonzero(starts) < 2:
        return out
    order = suffix_order(text.astype(np.int64) + 1, width)
    order = order[starts[order]]
    padded = np.concatenate((text, np.zeros(8, np.uint8))).tobytes()
    words = np.ndarray((len(text),), "<u8", padded, strides=(1,))
    one, two = order[:-1], order[1:]
    ends = [*range(0, width - 7, 8), width - 8]
    for at in ends:
        same = words[one + at] == words[two + at]
        one, two = one[same], two[same]
    out[one] = out[two] = True
    return out
