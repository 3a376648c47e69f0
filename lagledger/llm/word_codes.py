"""Words of whole texts as 64-bit codes, and codes of word windows, many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from lagledger.llm.common import cached

MOST_WORDS = 100_000  # cached per worker; a full cache is emptied, results stay the same
_codes: dict[bytes, bytes] = {}
cached("words", _codes.clear)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def split(text: str, lower: bool = False) -> list[bytes]:
    """Runs without space, tab, line feed, vertical tab, form feed or return, as UTF-8; ``lower`` turns A-Z to a-z."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_codes(words: list[list[bytes]]) -> np.ndarray:
    """One 64-bit code per word, all texts one after the other."""
    wanted = set().union(*words)
    new = [w for w in wanted if w not in _codes]
    if len(_codes) + len(new) > MOST_WORDS:
        _codes.clear()
        new = wanted
    for w in new:
        _codes[w] = xxhash.xxh3_64_digest(w)
    get = _codes.__getitem__
    return np.frombuffer(b"".join(b"".join(map(get, w)) for w in words), ">u8").astype(np.uint64)


def window_codes(codes: np.ndarray, width: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Rabin-Karp code, modulo 2^64, of every ``width`` consecutive codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].copy()
    for k in range(1, width):
        out *= multiplier
        out += codes[k : n + k]
    return out


def owners(words: list[list[bytes]]) -> np.ndarray:
    """For each word of all texts, the number of its text."""
    return np.repeat(np.arange(len(words)), [len(w) for w in words])


def scatter(codes: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit code of each code, as good as independent of the first."""
    x = codes ^ np.uint64(0xA0761D6478BD642F * (2 * salt + 1) & 0xFFFFFFFFFFFFFFFF)
    for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(a))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))
