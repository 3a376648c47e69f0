"""Hard negatives by coordinate pruning: sorted coordinate lists in length buckets, feasible ranges, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagledger.llm.ball_tree import matrix, widened
from lagledger.llm.common import staged

EVERY = 100
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
FOCUS = 3  # coordinates per anchor whose lists are asked
BUCKET = 2_048  # vectors of one label and similar length
BLOCK = 4_096  # anchors sent to every executor at a time
SEED_ROWS = 4_096  # vectors that give anchors their first limits
NONE = np.iinfo(np.int64).min
_EXACT = float(1 << 52)
_SLACK = 1e-9


@dataclass
class Bucket:
    """Vectors of one label with the sorted list of every coordinate of the directions."""

    label: int
    ids: np.ndarray
    x: np.ndarray
    longest: float
    unit: np.ndarray
    order: np.ndarray  # list k: rows in the order of coordinate k
    values: np.ndarray  # list k: the coordinates in that order

    @staticmethod
    def build(label: int, ids: np.ndarray, x: np.ndarray) -> Bucket:
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        unit = x / np.where(length > 0, length, 1)[:, None]
        order = np.argsort(unit, axis=0, kind="stable").T
        return Bucket(label, ids, x, float(length.max()), unit, order, np.take_along_axis(unit.T, order, 1))

    def feasible(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose coordinate lies, for each focus coordinate, where a direction at least this close to ``unit`` can lie."""
        if cosine <= 0 or not len(focus):
            return np.arange(len(self.ids))
        wide = np.arccos(min(1.0, cosine))
        turn = np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, turn + wide)) - _SLACK, np.cos(np.maximum(0, turn - wide)) + _SLACK
        ends = [(np.searchsorted(self.values[f], a, "left"), np.searchsorted(self.values[f], b, "right")) for f, a, b in zip(focus, low, high, strict=True)]
        first = min(range(len(focus)), key=lambda k: ends[k][1] - ends[k][0])
        rows = self.order[focus[first], ends[first][0] : ends[first][1]]
        for k, f in enumerate(focus):
            if k != first and len(rows):
                own = self.unit[rows, f]
                rows = rows[(own >= low[k]) & (own <= high[k])]
        return rows


def best_of(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest scores, ties to the smaller id."""
    return np.lexsort((ids, ~scores))[:most]


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    upper: np.ndarray  # anchor x positive; NONE where there is none

    def prepared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, directions, focus coordinates: the largest ones of each direction."""
        length = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))
        unit = self.x / np.where(length > 0, length, 1)[:, None]
        return length, unit, np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]


class Search:
    """Best scores of each anchor in each of its ranges, over the buckets shown so far.

    A range is [lower, upper] of the score; anchors without ranges of their own have one without ends. An anchor looks
    for scores not below its limit: the least, over its ranges, of the range's lower end and its kth score so far.
    """

    def __init__(self, anchors: Anchors, lower: np.ndarray, upper: np.ndarray, most: int, same: bool, floor: np.ndarray | None = None) -> None:
        self.anchors, self.lower, self.upper, self.most, self.same = anchors, lower, upper, most, same
        self.length, self.unit, self.focus = anchors.prepared()
        shape = (*lower.shape, most)
        self.scores, self.found = np.full(shape, NONE), np.full(shape, np.iinfo(np.int64).max)
        self.floor = lower.copy() if floor is None else np.maximum(lower, floor)

    def limits(self) -> np.ndarray:
        """Per anchor and range, what a score must reach."""
        return np.maximum(self.floor, self.scores[:, :, -1])

    def show(self, bucket: Bucket) -> None:
        asks = (self.anchors.labels == bucket.label) if self.same else (self.anchors.labels != bucket.label)
        limit = np.where(self.upper >= self.lower, self.limits(), np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        asks &= limit < np.iinfo(np.int64).max
        reach = self.length * bucket.longest * (1 + _SLACK)
        asks &= limit <= reach + _SLACK
        width = max(bucket.x.shape[1], self.anchors.x.shape[1])
        x, q = widened(bucket.x, width), widened(self.anchors.x, width)
        plain = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width < _EXACT
        if plain:
            x, q = x.astype(np.float64), q.astype(np.float64)
        for a in np.flatnonzero(asks):
            focus = self.focus[a][self.focus[a] < bucket.x.shape[1]]
            cosine = limit[a] / reach[a] if reach[a] > 0 else 0.0
            rows = bucket.feasible(self.unit[a], focus, cosine)
            rows = rows[bucket.ids[rows] != self.anchors.ids[a]]
            if not len(rows):
                continue
            scores = x[rows] @ q[a]
            scores = np.rint(scores).astype(np.int64) if plain else scores
            good = scores >= limit[a]
            if good.any():
                self._keep(a, scores[good], bucket.ids[rows[good]])

    def _keep(self, a: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for k in range(self.lower.shape[1]):
            inside = (scores >= self.lower[a, k]) & (scores <= self.upper[a, k])
            if inside.any():
                both, names = np.concatenate((self.scores[a, k], scores[inside])), np.concatenate((self.found[a, k], ids[inside]))
                best = best_of(both, names, self.most)
                self.scores[a, k], self.found[a, k] = both[best], names[best]

    def answers(self) -> pa.RecordBatch:
        a, k, m = np.nonzero(self.scores != NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchors.ids[a]), pa.array(k.astype(np.int32)), pa.array(self.found[a, k, m]), pa.array(self.scores[a, k, m])],
            names=["anchor_id", "part", "id", "score"],
        )


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    """Cuts rows (id, label, vector), ordered by label and length, where the label changes and after BUCKET rows."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        cut = np.concatenate(([0], np.flatnonzero(labels[1:] != labels[:-1]) + 1, [len(labels)])) if len(labels) else np.zeros(0, int)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            for at in range(a, b, BUCKET):
                part = batch.slice(at, min(BUCKET, b - at))
                yield Bucket.build(int(labels[at]), part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(2)))


def _asked(rows: pa.Table) -> Anchors:
    """Anchors (id, label, vector, upper ends); every executor gets them."""
    rows = rows.combine_chunks()
    n = rows.num_rows
    x = matrix(rows["v"].chunk(0)) if n else np.zeros((0, 1), np.int64)
    upper = np.full((n, POSITIVES), NONE)
    if n and "upper" in rows.column_names:
        for a, own in enumerate(rows["upper"].to_pylist()):
            upper[a, : len(own)] = own
    return Anchors(rows["id"].to_numpy(), rows["label"].to_numpy(), x, upper)


def _searched(rows: DataFrame, seeds: list[Bucket], make: Callable[[np.ndarray | None], Search]) -> DataFrame:
    """anchor_id, part, id, score: what each task found, starting from the kth scores among the seeds."""
    first = make(None)
    for bucket in seeds:
        first.show(bucket)
    floor = first.scores[:, :, -1].copy()
    shared = rows.sparkSession.sparkContext.broadcast((make, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, floor = shared.value
        search = make(floor)
        for bucket in buckets(batches):
            search.show(bucket)
        yield search.answers()

    return rows.mapInArrow(run, "anchor_id long, part int, id long, score long")


@dataclass
class _Positives:
    """Any score will do; picklable, as executors make their own."""

    anchors: Anchors
    most: int

    def __call__(self, floor: np.ndarray | None) -> Search:
        shape = (len(self.anchors.ids), 1)
        return Search(self.anchors, np.full(shape, NONE + 1), np.full(shape, np.iinfo(np.int64).max), self.most, True, floor)


@dataclass
class _Negatives:
    anchors: Anchors
    most: int
    percent: int

    def __call__(self, floor: np.ndarray | None) -> Search:
        upper = self.anchors.upper
        lower = np.where(upper == NONE, np.iinfo(np.int64).max, -(-self.percent * np.maximum(upper, 0) // 100))
        lower = np.where((upper < 0) & (upper != NONE), np.iinfo(np.int64).max, lower)  # a negative score has no such range
        return Search(self.anchors, lower, upper, self.most, False, floor)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "part").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def _in_blocks(blocks: int, of_block: Callable[[Column], DataFrame], name: str) -> DataFrame:
    pick = [F.pmod(F.xxhash64("id"), F.lit(blocks)) == number for number in range(blocks)]
    parts = [staged(of_block(p), name) for p in pick]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hard_negatives(
    vectors: DataFrame, label: Column, every: int = EVERY, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; scores are inner products of floor(scale * x). An anchor's positives
    are its best ``positives`` other rows of its ``label``; the negatives of a positive are the best ``negatives`` rows
    of other labels whose score lies between ``percent`` hundredths of the positive's score and that score. Ties go to the
    smaller id.

    1. Rows are written in the order of label and length. A task cuts them into length buckets of at most BUCKET rows of
       one label and sorts the directions' coordinates, one list per coordinate.
    2. An anchor with limit t on the score needs a cosine of t / (its length * the bucket's largest length): above 1 the
       bucket is left out. Otherwise the angle bounds, for its FOCUS largest coordinates, the range where the coordinate of
       such a direction lies; the shortest of these list ranges gives the candidates, the others are intersected.
    3. Candidates are verified by their exact product. Limits rise with the kth score, from bucket to bucket and from
       SEED_ROWS rows to every task.
    4. Positives first, then negatives, whose limits are the lower ends of the positives' ranges.

    Anchors go out in blocks of ``block`` rows, so what is broadcast is bounded; a label may hold any share of the rows, as
    it is only more buckets. Every row of another label stays a candidate until a bound excludes it.

    Edge cases: rows with a null id, label, vector or component, or a non-finite component, take no part; an empty vector has
    products of 0 and a shorter one ends in zeros; an anchor without another row of its label has no positives and gives no
    row, as does a positive below 0; a repeated anchor id is asked once (the smallest label and vector), its other rows
    never meet it; other rows that repeat an id are answers of their own; products are exact up to 64 bits; other columns
    are ignored.
    """
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * float(scale)))
    clean = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & ~bad)
    clean = clean.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    clean = clean.withColumn("size", length).repartitionByRange("label", F.desc("size"), "id").sortWithinPartitions("label", F.desc("size"), "id").drop("size")
    clean = staged(clean, "vectors")

    alone = Window.partitionBy("id").orderBy("label", "v")
    anchors = clean.filter(F.col("id") % every == 0).withColumn("n", F.row_number().over(alone)).filter("n = 1").drop("n")
    anchors = staged(anchors, "anchors")
    blocks = max(1, -(-anchors.count() // block))
    seeds = list(buckets(clean.limit(SEED_ROWS).toArrow().to_batches()))

    def positives_of(own: Column) -> DataFrame:
        asked = _asked(anchors.filter(own).toArrow())
        return _searched(clean, seeds, _Positives(asked, positives))

    found = _ranked(_in_blocks(blocks, positives_of, "positives"), positives)
    found = staged(found.select("anchor_id", (F.col("rank") - 1).cast("int").alias("part"), F.col("id").alias("positive_id"), "score"), "positives")
    ends = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("part", "score"))).alias("ends"))  # at most ``positives`` each
    with_ends = staged(anchors.join(ends, anchors["id"] == ends["anchor_id"]).select("id", "label", "v", F.col("ends.score").alias("upper")), "anchors")

    def negatives_of(own: Column) -> DataFrame:
        asked = _asked(with_ends.filter(own).toArrow())
        return _searched(clean, seeds, _Negatives(asked, negatives, percent))

    got = _ranked(_in_blocks(blocks, negatives_of, "negatives"), negatives).select(
        "anchor_id", "part", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return got.join(found.withColumnRenamed("score", "positive_score"), ["anchor_id", "part"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
