"""Clusters round exact centroids, by a vector approximation file: few-bit cells first, whole vectors where they must decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagledger.llm.ball_tree import matrix
from lagledger.llm.common import staged

CLUSTERS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
BITS = 5
ROWS = 4_096  # vectors whose tables of distances are held at once
NEW = -1  # cluster of a vector that no round has seen
OPEN = -2  # its intervals overlap


class Grid:
    """Cells of equal width per dimension, between the least and the largest integer there."""

    def __init__(self, least: np.ndarray, most: np.ndarray, bits: int) -> None:
        self.least = least
        self.step = np.maximum(1, -(-(most - least + 1) // (1 << bits)))
        cells = np.arange(1 << bits)
        self.low = least[:, None] + cells * self.step[:, None]  # dimension x cell
        self.high = np.minimum(self.low + self.step[:, None] - 1, np.maximum(most, least)[:, None])
        self.high = np.maximum(self.low, self.high)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.least) // self.step).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per centroid, dimension and cell: least and largest share in the squared distance, without the vector's own square.

        The square of the vector is the same for every centroid; without it, (c - 2 x) c is linear in x, and its bounds
        lie at the borders of the cell.
        """
        c = centroids[:, :, None]
        one, other = c * (c - 2 * self.low), c * (c - 2 * self.high)
        return np.minimum(one, other), np.maximum(one, other)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; ties go to the smaller number."""
    far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = far.argmin(1)
    return best.astype(np.int32), far[np.arange(len(x)), best]


def decide(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The cluster where one centroid's interval ends below all others (or meets a larger number at its end), else OPEN."""
    dims = np.arange(cells.shape[1])
    least = np.stack([t[dims, cells].sum(1) for t in low], 1)
    most = np.stack([t[dims, cells].sum(1) for t in high], 1)
    best = most.argmin(1)
    rows = np.arange(len(cells))
    top = most[rows, best][:, None]
    number = np.arange(len(low))
    beaten = (least > top) | ((least == top) & (number > best[:, None])) | (number == best[:, None])
    return np.where(beaten.all(1), best, OPEN).astype(np.int32)


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of one length as a matrix; a sliced column keeps its own part."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _approximate(batches: Iterator[pa.RecordBatch], grid: Grid) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        cells = grid.cells(matrix(part.column(1)))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([r.tobytes() for r in cells], pa.binary()), pa.array(np.full(len(cells), NEW, np.int32))], names=["row", "cells", "old"]
        )


def _bound(batches: Iterator[pa.RecordBatch], grid: Grid, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    low, high = grid.tables(centroids)
    for part in _parts(batches):
        new = decide(_bytes(part.column(1)), low, high)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new)], names=["row", "cells", "old", "new"])


def _resolve(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows with their whole vectors: the cluster, where it was open."""
    for part in _parts(batches):
        new = part.column(3).to_numpy(zero_copy_only=False).copy()
        unsure = np.flatnonzero(new == OPEN)
        if len(unsure):
            new[unsure] = nearest(matrix(part.column(4))[unsure], centroids)[0]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(new), part.column(3), part.column(4)], names=["row", "cells", "old", "new", "was", "x"])


def _changes(batches: Iterator[pa.RecordBatch], clusters: int, width: int) -> Iterator[pa.RecordBatch]:
    """Per cluster and dimension, what a task's moving vectors add to the sum; dimension -1 counts them."""
    sums = np.zeros((clusters, width + 1), np.int64)
    for part in _parts(batches):
        x = np.pad(matrix(part.column(2)), ((0, 0), (1, 0)), constant_values=1)
        old, new = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        np.add.at(sums, new, x)
        np.subtract.at(sums, old[old >= 0], x[old >= 0])
    cluster, dim = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array((dim - 1).astype(np.int32)), pa.array(sums[cluster, dim])], names=["cluster", "dim", "change"])


def _finish(batches: Iterator[pa.RecordBatch], grid: Grid, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    low, high = grid.tables(centroids)
    for part in _parts(batches):
        x = matrix(part.column(1))
        cluster = decide(grid.cells(x), low, high)
        unsure = cluster == OPEN
        if unsure.any():
            cluster[unsure] = nearest(x[unsure], centroids)[0]
        far = ((x - centroids[cluster]) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster), pa.array(far)], names=["id", "cluster", "distance"])


def centroid_clusters(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, bits: int = BITS,
    seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``width`` components, none null or non-finite; a component becomes floor(scale * x).
    Centroids start as the kept vectors whose ids have the smallest SHA-256 of ``<seed>:<id>``. Each round assigns every
    vector to the nearest centroid (squared distance, ties to the smaller number) and moves each centroid that has
    vectors to the floor of their mean; then vectors are assigned once more.

    1. Every vector is compressed to one cell of ``bits`` bits per dimension, written beside the vectors.
    2. A round reads cells only. Tables of the least and largest share of each cell in each centroid's distance give an
       interval per centroid; where one interval lies below all others the vector is decided.
    3. Whole vectors are fetched by a join for rows whose intervals overlap, and for rows that change their cluster:
       the sums of a cluster move by what enters and leaves, so rows that stay are not read again.
    4. Only sums per cluster and dimension reach the driver, clusters x (width + 1) numbers.

    Each task holds ROWS vectors at a time and one table of sums. No step groups rows by cluster in one task, so a
    cluster may hold any share of the rows.

    Edge cases: fewer kept vectors than ``clusters`` give as many centroids as there are vectors; equal vectors meet the
    smaller number; rows that repeat an id are vectors of their own (equal hashes are ordered by the vector); a null id
    is kept and hashed as an empty one; no kept vectors give no rows; other columns are ignored. Distances are exact while
    they fit in 64 bits.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.filter((F.size(x) == width) & ~bad)
    kept = kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * float(scale))).alias("x"))
    full = staged(kept, "vectors")

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = full.orderBy(order, "x").limit(clusters).select("x").collect()
    if not first:
        schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema).select(F.lit(None).cast(vectors.schema[id_col].dataType).alias(id_col), "*")
    centroids = np.array([r["x"] for r in first], np.int64)
    ends = full.select(F.posexplode("x")).groupBy("pos").agg(F.min("col").alias("least"), F.max("col").alias("most")).orderBy("pos").collect()
    grid = Grid(np.array([r["least"] for r in ends]), np.array([r["most"] for r in ends]), bits)

    sums = np.zeros((len(centroids), width + 1), np.int64)
    state = staged(full.select("row", "x").mapInArrow(partial(_approximate, grid=grid), "row long, cells binary, old int"), "cells")
    for turn in range(rounds):
        bounds = staged(state.mapInArrow(partial(_bound, grid=grid, centroids=centroids), "row long, cells binary, old int, new int"), "bounds")
        moving = bounds.filter(f"new = {OPEN} OR new <> old").join(full.select("row", "x"), "row").select("row", "cells", "old", "new", "x")
        moving = staged(moving.mapInArrow(partial(_resolve, centroids=centroids), "row long, cells binary, old int, new int, was int, x array<long>"), "moving")
        changes = moving.filter("old <> new").select("old", "new", "x")
        changes = changes.mapInArrow(partial(_changes, clusters=len(centroids), width=width), "cluster int, dim int, change long")
        for r in changes.groupBy("cluster", "dim").agg(F.sum("change").alias("change")).collect():
            sums[r["cluster"], r["dim"] + 1] += r["change"]
        some = sums[:, 0] > 0
        centroids = np.where(some[:, None], sums[:, 1:] // np.maximum(sums[:, :1], 1), centroids)
        if turn < rounds - 1:
            settled = bounds.filter(f"new <> {OPEN}").select("row", "cells", F.col("new").alias("old"))
            state = settled.unionByName(moving.filter(f"was = {OPEN}").select("row", "cells", F.col("new").alias("old")))

    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long"
    out = staged(full.select("id", "x").mapInArrow(partial(_finish, grid=grid, centroids=centroids), schema), "clusters")
    own = {r["cluster"]: r["inertia"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    known = [(k, own.get(k, 0), sum(own.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row per centroid
    return out.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
