"""Hard negatives, centroid clusters and suffix dedup against brute force, on awkward rows and on empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagledger.llm import hard_negatives as hard
from lagledger.llm import suffix_dedup as suffix
from lagledger.llm import va_clusters as va
from lagledger.llm.hard_negatives import Bucket, hard_negatives
from lagledger.llm.suffix_dedup import remove_repeated_bytes
from lagledger.llm.suffix_order import repeated_starts, suffix_order
from lagledger.llm.va_clusters import centroid_clusters

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("id", "row", "cells", "cluster", "v", "x", "rank", "score", "anchor_id", "size")],
])


def vector_rows(width: int = 8, count: int = 160) -> list[tuple]:
    """A hot label, ties and copies, repeated and null ids, null and non-finite components, empty and short vectors."""
    r = np.random.default_rng(3)
    out = []
    for k in range(count):
        v = [float(np.float32(c)) for c in r.normal(size=width) / 3 + (0.4 if k % 2 else 0)]
        out.append([k, v, 1 if k % 3 else int(k % 5)])
    for k in range(20, 40):
        out[k][1] = list(out[k - 20][1])  # ties
    out[50][1], out[51][1], out[52][1] = None, [None] + [0.1] * (width - 1), [float("nan")] + [0.1] * (width - 1)
    out[53][1], out[54][1], out[55][1] = [float("inf")] * width, [], [0.0] * width
    out[56][2], out[57][0], out[58][1] = None, None, [0.5] * (width - 3)
    out += [[10, [0.3] * width, 1], [10, [0.2] * width, 1], [7, list(out[7][1]), 1], [7, list(out[7][1]), 1]]
    return [tuple(x) + tuple("abcdefghij") for x in out]


def usable(row: tuple) -> bool:
    return row[1] is not None and all(c is not None and np.isfinite(c) for c in row[1])


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS).repartition(3)


@pytest.fixture(scope="module")
def no_vectors(spark):
    return spark.createDataFrame([], VECTORS)


# --- hard negatives


def brute_negatives(every: int) -> Counter:
    rows = [r for r in vector_rows() if usable(r) and r[0] is not None and r[2] is not None]
    dot = lambda a, b: sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=False))
    anchors = {}
    for r in sorted(rows, key=lambda r: (r[2], [np.floor(256 * c) for c in r[1]])):
        if r[0] % every == 0:
            anchors.setdefault(r[0], r)
    out = Counter()
    for a in anchors.values():
        others = sorted([(-dot(a[1], r[1]), r[0], r[2]) for r in rows if r[0] != a[0]])
        for s, p, _ in [o for o in others if o[2] == a[2]][:5]:
            fit = [o for o in others if o[2] != a[2] and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out.update((a[0], p, k + 1, o[1], -s, -o[0]) for k, o in enumerate(fit))
    return out


@pytest.mark.parametrize("block", [4096, 6])
def test_hard_negatives(vectors, no_vectors, block):
    got = hard_negatives(vectors, F.col("label"), every=5, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(5)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    assert hard_negatives(no_vectors, F.col("label")).count() == 0


def test_hard_negatives_without_positives_or_other_labels(spark):
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.4], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df, F.col("label"), every=1).count() == 0  # no other row of a label
    assert hard_negatives(df, F.lit(1), every=1).count() == 0  # no other label


def test_feasible_ranges_lose_no_vector():
    r = np.random.default_rng(1)
    x = np.rint(r.normal(size=(500, 16)) * 90).astype(np.int64)
    bucket = Bucket.build(0, np.arange(500), x)
    for _ in range(50):
        q = np.rint(r.normal(size=16) * 90)
        unit = q / np.sqrt((q**2).sum())
        for cosine in (-0.5, 0.0, 0.2, 0.5, 0.9):
            rows = bucket.feasible(unit, np.argsort(-np.abs(unit))[: hard.FOCUS], cosine)
            assert set(np.flatnonzero(bucket.unit @ unit >= cosine)) <= set(rows)
    assert len(bucket.feasible(unit, np.argsort(-np.abs(unit))[: hard.FOCUS], 0.9)) < 500


# --- centroid clusters


def brute_clusters(width: int, clusters: int = 16, rounds: int = 3) -> Counter:
    kept = [r for r in vector_rows() if r[1] is not None and len(r[1]) == width and usable(r)]
    x = np.array([[int(np.floor(64 * c)) for c in r[1]] for r in kept])
    name = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    first = sorted(range(len(kept)), key=lambda k: (name(kept[k]), x[k].tolist()))[:clusters]
    c = x[first]
    for turn in range(rounds + 1):
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        own = far.argmin(1)
        if turn < rounds:
            c = np.array([x[own == k].sum(0) // (own == k).sum() if (own == k).any() else c[k] for k in range(len(c))])
    least = far.min(1)
    return Counter(
        (r[0], int(k), int(d), int(least[own == k].sum()), int(least.sum()), hashlib.sha256(",".join(map(str, c[k].tolist())).encode()).hexdigest())
        for r, k, d in zip(kept, own, least, strict=True)
    )


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_centroid_clusters(vectors, no_vectors, bits):
    got = centroid_clusters(vectors, width=8, bits=bits)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_clusters(8)
    none = centroid_clusters(no_vectors)
    assert none.count() == 0 and none.schema["vec_id"].dataType == T.LongType()


def test_fewer_vectors_than_clusters(vectors):
    got = centroid_clusters(vectors, width=5).collect()  # one vector of five components
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in got] == [(0, 0, 0)]


def test_intervals_hold_the_distances_and_decide_rightly():
    r = np.random.default_rng(2)
    x, c = r.integers(-40, 40, (400, 12)), r.integers(-40, 40, (6, 12))
    grid = va.Grid(x.min(0), x.max(0), 4)
    low, high = grid.tables(c)
    cells, dims = grid.cells(x), np.arange(12)
    own = (x**2).sum(1)
    for k in range(6):
        far = ((x - c[k]) ** 2).sum(1) - own
        assert (low[k][dims, cells].sum(1) <= far).all() and (far <= high[k][dims, cells].sum(1)).all()
    got, want = va.decide(cells, low, high), va.nearest(x, c)[0]
    assert ((got == want) | (got == va.OPEN)).all() and (got != va.OPEN).mean() > 0.5


def test_ties_go_to_the_smaller_number():
    x, c = np.array([[3, 3]]), np.array([[9, 9], [5, 5], [1, 1], [5, 5]])
    grid = va.Grid(np.array([0, 0]), np.array([7, 7]), 3)
    assert va.nearest(x, c)[0][0] == 1 and va.decide(grid.cells(x), *grid.tables(c))[0] == 1


# --- suffixes


def brute_bytes(texts: list[str], width: int) -> list[tuple]:
    raw = [t.encode() for t in texts]
    seen = Counter(b[k : k + width] for b in raw for k in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("size,letters,depth", [(1, 3, 5), (2, 2, 9), (3, 2, 9), (4, 1, 9), (100, 2, 200), (301, 3, 7), (1000, 1, 50), (1001, 26, 30), (1002, 4, 200)])
def test_suffix_order(size, letters, depth):
    r = random.Random(size)
    s = [r.randint(1, letters) for _ in range(size)]
    order = suffix_order(np.array(s), depth).tolist()
    assert sorted(order) == list(range(size))
    heads = [s[k : k + depth] for k in order]
    assert heads == sorted(heads)


def test_suffix_order_refuses_more_symbols_than_it_can_name():
    with pytest.raises(ValueError):
        suffix_order(np.ones(4_000_000, np.int64), 3)


def test_repeated_starts_look_at_given_starts_only():
    text = np.frombuffer(b"0123456789" * 3 + b"abcdefghij" * 2, np.uint8)
    starts = np.zeros(len(text), bool)
    starts[[0, 5, 10, 35]] = True
    assert np.flatnonzero(repeated_starts(text, starts, 10)).tolist() == [0, 10]


@pytest.mark.parametrize("width,gram,most", [(200, 64, suffix.MOST), (40, 16, suffix.MOST), (40, 16, 0), (24, 8, 2_000)])
def test_remove_repeated_bytes(docs, none, width, gram, most):
    """``most`` sends no, all or some anchors to the counted windows."""
    plain = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = remove_repeated_bytes(docs, width, gram, most)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    rows = got.collect()
    want = Counter((d, *b) for (d, _), b in zip(plain, brute_bytes([t for _, t in plain], width), strict=True))
    assert Counter(tuple(r)[:5] for r in rows) == want and sum(k[2] for k in want) > 1000
    assert all(sum(s["b"] - s["a"] for s in r["removed"]) == r["n_removed"] and len(r["removed"]) == r["n_spans"] for r in rows)
    assert remove_repeated_bytes(none).count() == 0


def test_long_runs_null_ids_and_repeated_ids(spark):
    shared = "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    texts = ["x" * 20_000, "é" * 150, shared, f"1{shared}2", None, None, shared]
    ids = [1, 1, None, None, 5, None, 2]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    want = Counter((d, *b) for d, b in zip(ids, brute_bytes([t or "" for t in texts], 200), strict=True))
    assert Counter(tuple(r)[:5] for r in remove_repeated_bytes(df).collect()) == want


def test_parts_of_long_texts_and_cut_blocks(monkeypatch):
    """Small parts, runs and orders give the windows that one part gives."""
    monkeypatch.setattr(suffix, "PIECE", 700)
    monkeypatch.setattr(suffix, "RUN", 50)
    monkeypatch.setattr(suffix, "TEXT", 3_000)
    import pyarrow as pa

    r = random.Random(8)
    prose = "".join(r.choice("abc ") for _ in range(2_000))
    text = (prose[:1_500] + "y" * 900 + prose[300:]).encode()
    codes = Counter(c for _, p in suffix._pieces(text, 40) for c in suffix.anchors(p, 40, 16)[1].view(np.int64).tolist())
    known = [c for c, n in codes.items() if n > 1]
    batch = pa.RecordBatch.from_arrays([pa.array([b"d"]), pa.array([text]), pa.array([known])], names=["digest", "text", "known"])
    blocks = [x for b in suffix._blocks(iter([batch]), 40, 16) for x in b.to_pylist()]
    count = Counter((b["anchor"], b["one"], b["two"], b["block"]) for b in blocks)
    rows = sorted((a, one, two, n, block) for (a, one, two, block), n in count.items())
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    names = ["anchor", "one", "two", "copies", "block"]
    table = pa.RecordBatch.from_arrays(columns, names=names)
    marks = {(m["one"], m["two"]): m["spans"] for b in suffix._ordered(iter([table.slice(0, 7), table.slice(7)]), 40) for m in b.to_pylist()}
    got = {b["at"] + k for b in blocks for s in marks.get((b["one"], b["two"]), []) for k in range(s["a"], s["b"])}
    seen = Counter(text[k : k + 40] for k in range(len(text) - 39))
    assert got == {k for k in range(len(text) - 39) if seen[text[k : k + 40]] > 1}
