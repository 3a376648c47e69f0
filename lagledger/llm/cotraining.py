"""A quality classifier trained on two views that teach each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagledger.llm.common import draw, staged, text_of
from lagledger.llm.word_codes import owners, scatter, split, window_codes, word_codes
from lagledger.session import broadcast_if_small

BUCKETS = 1 << 12  # hashed text features
NAMES = 64  # hashed values of each metadata name
FIT_ROWS = 8_000  # labelled rows the models are fitted on, a seeded draw
CALIBRATION_ROWS = 4_000  # labelled rows kept apart for calibration
ROUNDS = 3
PER_ROUND = 1_000  # pseudo-labels a view hands over per round so far, by the classes' shares
SURE = 0.9  # a pseudo-label needs this probability
STEPS = 60
_SHAPE = 10


def _text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends per text, bucket, count up to 255): words, word pairs, words' last bytes, and words that come again at once."""
    words = [split(t, lower=True) for t in texts]
    codes, owner = word_codes(words), owners(words)
    pairs = window_codes(codes, 2)
    inside = owner[: len(pairs)] == owner[1:] if len(owner) else np.zeros(0, bool)
    same = inside & (codes[:-1] == codes[1:]) if len(codes) else inside
    last = np.array([w[-1] for ws in words for w in ws], np.uint64)
    half, quarter = BUCKETS // 2, BUCKETS // 4
    rows = np.concatenate((owner, owner[: len(pairs)][inside], owner, owner[: len(pairs)][same]))
    bucket = np.concatenate((
        (scatter(codes, 1) >> np.uint64(40)).astype(np.int64) % half,
        half + (scatter(pairs[inside], 2) >> np.uint64(40)).astype(np.int64) % quarter,
        half + quarter + 1 + last.astype(np.int64),
        np.full(int(same.sum()), half + quarter),
    ))
    key, count = np.unique(rows * BUCKETS + bucket, return_counts=True)
    ends = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    return ends, (key % BUCKETS).astype(np.uint16), np.minimum(count, 255).astype(np.uint8)


def _shape(text: Column, chars: Column) -> list[Column]:
    """Layout numbers of a page: its length, its lines, and which kinds of characters fill it."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    lines = count("\n") + 1
    return [
        F.log1p(F.coalesce(chars.cast("double"), n)) / 10, F.log1p(lines) / 5, F.log1p(n / lines) / 10,
        count(r"\p{L}") / n, count(r"\d") / n, count(r"\p{Lu}") / n, count(r"\s") / n,
        count(r"[^\p{L}\d\s.,]") / n, F.log1p(count(r"[^\p{L}\d\s.,]{2,}")) / 10, count(r"[.,]") / n,
    ]


def _column(docs: DataFrame, name: str) -> Column:
    return F.col(name) if name in docs.columns else F.lit(None)


@dataclass
class Rows:
    """Features of a bounded set of rows on the driver: sparse text, dense metadata."""

    ends: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    meta: np.ndarray

    @staticmethod
    def of(buckets: list[bytes], counts: list[bytes], meta: list[bytes]) -> Rows:
        ends = np.cumsum([0, *[len(c) for c in counts]])
        value = np.log1p(np.frombuffer(b"".join(counts), np.uint8).astype(np.float32))
        norm = np.sqrt(np.add.reduceat(np.append(value**2, 0), ends[:-1]) * (np.diff(ends) > 0)) if len(counts) else np.zeros(0)
        value = value / np.repeat(np.maximum(norm, 1e-9), np.diff(ends)).astype(np.float32)
        dense = np.frombuffer(b"".join(meta), np.float32).reshape(len(meta), -1).astype(np.float64) if meta else np.zeros((0, _SHAPE + 2 * NAMES))
        return Rows(ends, np.frombuffer(b"".join(buckets), np.uint16), value, dense)

    def text_score(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(w[self.bucket] * self.value)))
        return sums[self.ends[1:]] - sums[self.ends[:-1]] + w[BUCKETS]

    def meta_score(self, w: np.ndarray) -> np.ndarray:
        return self.meta @ w[:-1] + w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(score, gradient, size: int, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = STEPS) -> np.ndarray:
    """Logistic regression by Adagrad on all rows; classes weigh the same."""
    w, seen = np.zeros(size), np.full(size, 1e-8)
    if not len(y) or y.min() == y.max():
        if len(y):
            w[-1] = 2.0 if y[0] else -2.0
        return w
    weight = weight * np.where(y > 0, 0.5 / (weight @ y), 0.5 / (weight @ (1 - y)))
    for _ in range(steps):
        g = gradient(weight * (_sigmoid(score(w)) - y)) + ridge * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def _fit_text(rows: Rows, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    def gradient(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(rows.bucket, np.repeat(r, np.diff(rows.ends)) * rows.value, BUCKETS), r.sum())

    return _descend(rows.text_score, gradient, BUCKETS + 1, y, weight, 1e-5)


def _fit_meta(rows: Rows, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return _descend(rows.meta_score, lambda r: np.append(r @ rows.meta, r.sum()), rows.meta.shape[1] + 1, y, weight, 1e-5, 4 * STEPS)


def _calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and intercept that turn scores (columns of z) into log odds, by Newton steps; slopes stay positive."""
    x = np.column_stack((z, np.ones(len(y))))
    start = np.append(np.ones(x.shape[1] - 1) / max(1, x.shape[1] - 1), 0.0)
    if len(y) < 10 or y.min() == y.max():
        return start
    w = start.copy()
    prior = np.eye(x.shape[1]) * 1e-2
    for _ in range(30):
        p = _sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (p - y) + prior @ (w - start))
    return w if (w[:-1] > 0).all() else start


@dataclass(frozen=True)
class Model:
    text: np.ndarray
    meta: np.ndarray
    calibrated: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def views(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of either view."""
        (a, b), (c, d) = self.calibrated
        return a * rows.text_score(self.text) + b, c * rows.meta_score(self.meta) + d

    def score(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, meta = self.views(rows)
        return _sigmoid(text), _sigmoid(meta), _sigmoid(self.combined[0] * text + self.combined[1] * meta + self.combined[2])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, buckets, counts (text view), meta (metadata view: source, language, length and layout) for every row."""
    text = F.col("text")
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), _column(docs, "n_chars").alias("chars"),
        *[F.pmod(F.xxhash64(F.coalesce(_column(docs, c).cast("string"), F.lit(""))), F.lit(NAMES)).cast("int").alias(c) for c in ("source", "lang")],
    )
    base = base.select("id", "text", "source", "lang", F.array(*_shape(text, F.col("chars"))).alias("shape"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ends, bucket, count = _text_features(part.column(1).to_pylist())
                meta = np.zeros((part.num_rows, _SHAPE + 2 * NAMES), np.float32)
                meta[:, :_SHAPE] = part.column(4).flatten().to_numpy().reshape(-1, _SHAPE)
                every = np.arange(part.num_rows)
                meta[every, _SHAPE + part.column(2).to_numpy()] = 1
                meta[every, _SHAPE + NAMES + part.column(3).to_numpy()] = 1
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([bucket[a:b].tobytes() for a, b in spans], pa.binary()),
                     pa.array([count[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())],
                    names=["id", "buckets", "counts", "meta"],
                )

    return base.mapInArrow(run, "id long, buckets binary, counts binary, meta binary")


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                got = shared.value.score(Rows.of(*(part.column(k).to_pylist() for k in (1, 2, 3))))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(g) for g in got]], names=["id", "p_text", "p_meta", "score"])

    return rows.select("id", "buckets", "counts", "meta").mapInArrow(run, "id long, p_text double, p_meta double, score double")


def _fetch(rows: DataFrame, labels: DataFrame) -> tuple[Rows, np.ndarray]:
    """Features and labels of a bounded set of ids."""
    got = rows.join(broadcast_if_small(labels), "id").select("id", "buckets", "counts", "meta", "y").toArrow().sort_by([("id", "ascending")])
    return Rows.of(*(got.column(c).to_pylist() for c in ("buckets", "counts", "meta"))), got.column("y").to_numpy().astype(np.float64)


def _joined(a: tuple[Rows, np.ndarray], b: tuple[Rows, np.ndarray]) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Labelled rows and, at half weight, pseudo-labelled ones."""
    (x, y), (p, q) = a, b
    rows = Rows(np.concatenate((x.ends, x.ends[-1] + p.ends[1:])), np.concatenate((x.bucket, p.bucket)), np.concatenate((x.value, p.value)), np.concatenate((x.meta, p.meta)))
    return rows, np.concatenate((y, q)), np.concatenate((np.ones(len(y)), np.full(len(q), 0.5)))


def co_train(
    rows: DataFrame, labels: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS
) -> Model:
    """A model from ``rows`` (:func:`features`) and labels (id, y).

    At most ``fit_rows`` and ``calibration_rows`` labelled rows, a seeded draw, come to the driver. Each round scores all
    rows; each view names its surest unlabelled rows, per class ``per_round`` times the round's number times the class's
    share, and the other view is fitted again with them. Views are calibrated on the rows kept apart.
    """
    drawn = labels.withColumn("draw", draw("label", F.col("id"))).orderBy("draw", "id").limit(fit_rows + calibration_rows)
    drawn = staged(drawn.select("id", "y", F.expr(f"pmod(draw, {fit_rows + calibration_rows}) < {fit_rows}").alias("fit")), "drawn")
    fit, apart = _fetch(rows, drawn.filter("fit")), _fetch(rows, drawn.filter("NOT fit"))
    none = (Rows.of([], [], []), np.zeros(0))
    for_text = for_meta = none
    share = float(fit[1].mean()) if len(fit[1]) else 0.5
    for number in range(rounds + 1):
        text, meta = _fit_text(*_joined(fit, for_text)), _fit_meta(*_joined(fit, for_meta))
        plain = Model(text, meta, (np.array([1.0, 0.0]), np.array([1.0, 0.0])), np.array([0.5, 0.5, 0.0]))
        z = plain.views(apart[0])
        calibrated = tuple(_calibrate(v[:, None], apart[1]) for v in z)
        model = Model(text, meta, calibrated, plain.combined)
        model = Model(text, meta, calibrated, _calibrate(np.column_stack(model.views(apart[0])), apart[1]))
        if number == rounds or not len(fit[1]):
            return model
        scores = staged(_scored(rows, model).join(labels.select("id"), "id", "left_anti"), "scores")

        def surest(view: str) -> DataFrame:
            wanted = (number + 1) * per_round
            tie = draw("tie", F.col("id"))
            high = scores.filter(F.col(view) >= SURE).orderBy(F.desc(view), tie, "id").limit(max(1, round(wanted * share))).select("id", F.lit(1.0).alias("y"))
            low = scores.filter(F.col(view) <= 1 - SURE).orderBy(view, tie, "id").limit(max(1, round(wanted * (1 - share)))).select("id", F.lit(0.0).alias("y"))
            return high.unionByName(low).dropDuplicates(["id"])

        for_text, for_meta = _fetch(rows, surest("p_meta")), _fetch(rows, surest("p_text"))
    raise AssertionError


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """One row per input row: ``id_col``, p_text, p_meta, score, keep (score of at least one half).

    p_text and p_meta are the calibrated views, score their combination: the probability of label 1.

    Edge cases: a null or empty text has no text features; missing or null metadata is a value of its own; labels that
    are null are left out, several for one id count as their mean, rounded; without labels every score is one half, and
    with one class all rows lean to it; rows that repeat an id are scored each; other columns are ignored.
    """
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    y = y.agg(F.when(F.avg(F.col(label_col).cast("double")) >= 0.5, 1.0).otherwise(0.0).alias("y"))
    rows = staged(features(docs, id_col, text_col), "features")
    model = co_train(rows, y, **options)
    return _scored(rows, model).select(F.col("id").alias(id_col), "p_text", "p_meta", "score", (F.col("score") >= 0.5).alias("keep"))
