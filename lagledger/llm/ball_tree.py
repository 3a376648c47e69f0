"""Exact largest inner products by branch and bound on a ball tree per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagledger.llm.common import staged

TOP = 5
EVERY = 50
SCALE = 256
LEAF = 128
SHARD = 8_192  # vectors per tree
BLOCK = 8_192  # queries sent to every executor at a time
SEED_ROWS = 4_096  # vectors that give each query its first kth score
NONE = np.iinfo(np.int64).min
_EXACT = float(1 << 52)


def matrix(rows: pa.Array) -> np.ndarray:
    """Integer vectors as a matrix; shorter ones end in zeros."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(rows.offsets.to_numpy())
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = flat
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


@dataclass(frozen=True)
class BallTree:
    vectors: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    leaves: list[tuple[int, int, int]]  # node, from, to

    @staticmethod
    def build(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
        """Each node is halved along the line between two far points, until ``leaf`` vectors are left."""
        points = vectors.astype(np.float64)
        order = np.arange(len(ids))
        centre, radius, parent, leaves = [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, above = todo.pop()
            own = points[order[a:b]]
            middle = own.mean(0)
            away = ((own - middle) ** 2).sum(1)
            node = len(centre)
            centre.append(middle)
            radius.append(np.sqrt(away.max()) * (1 + 1e-9) + 1e-9)
            parent.append(above)
            if b - a <= leaf:
                leaves.append((node, a, b))
                continue
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (other - one), half)]
            todo += [(a, a + half, node), (a + half, b, node)]
        return BallTree(vectors[order], ids[order], np.array(centre), np.array(radius), np.array(parent), leaves)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, scores: np.ndarray, found: np.ndarray, floor: np.ndarray) -> None:
        """Improves each query's best ``scores`` and ``found`` ids in place; ``floor`` is a kth score known from elsewhere.

        A node holds no inner product above q.c + |q| r. A child's bound is never above its parent's, so a node below the
        kth score closes its whole branch. Each query visits its leaves from the largest bound down and stops at the
        first one below its kth score; queries at the same leaf share one product of matrices.
        """
        width = max(queries.shape[1], self.vectors.shape[1])
        q, x = widened(queries, width), widened(self.vectors, width)
        qf, xf = q.astype(np.float64), x.astype(np.float64)
        plain = np.abs(qf).max(initial=0) * np.abs(xf).max(initial=0) * width < _EXACT
        bound = qf @ widened(self.centre, width).T + np.sqrt((qf**2).sum(1))[:, None] * self.radius
        for node in range(1, len(self.parent)):  # parents come first
            np.minimum(bound[:, node], bound[:, self.parent[node]], out=bound[:, node])
        at_leaf = bound[:, [n for n, _, _ in self.leaves]]
        order = np.argsort(-at_leaf, axis=1)
        active = np.arange(len(q))
        for turn in range(len(self.leaves)):
            leaf = order[active, turn]
            kth = np.maximum(scores[active, -1], floor[active])
            open_ = at_leaf[active, leaf] + 0.5 + 1e-9 * np.abs(at_leaf[active, leaf]) >= kth
            active, leaf = active[open_], leaf[open_]
            if not len(active):
                return
            by_leaf = np.argsort(leaf, kind="stable")
            for own in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                _, a, b = self.leaves[order[own[0], turn]]
                new = np.rint(qf[own] @ xf[a:b].T).astype(np.int64) if plain else q[own] @ x[a:b].T
                new[self.ids[a:b] == query_ids[own][:, None]] = NONE
                both = np.concatenate((scores[own], new), 1)
                ids = np.concatenate((found[own], np.broadcast_to(self.ids[a:b], new.shape)), 1)
                best = np.lexsort((ids, -both.astype(np.float64) if plain else ~both), axis=1)[:, : scores.shape[1]]
                scores[own] = np.take_along_axis(both, best, 1)
                found[own] = np.take_along_axis(ids, best, 1)


def top_products(
    vectors: DataFrame, top: int = TOP, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """query_id, rank, ``id_col``, score: per query the ``top`` rows with the largest integer inner product.

    Components become floor(scale * x). Queries are the ids divisible by ``every``; a query meets every row of another
    id; ties go to the smaller id.

    Queries go out in blocks of about ``block`` rows, so what is broadcast is bounded. Each task cuts its rows into shards,
    builds a :class:`BallTree` on each and searches the whole block in it, carrying every query's kth score from shard to
    shard; all tasks start from the kth score among SEED_ROWS rows, a lower bound of the true one. Tasks return at most
    ``top`` rows a query.

    Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; fewer rows
    than ``top`` give fewer answers; a shorter vector counts as ending in zeros; a repeated query id is asked once; other
    rows that repeat an id are answers of their own; products are exact up to 64 bits; other columns are ignored.
    """
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * float(scale)))
    clean = vectors.filter(F.col(id_col).isNotNull() & (F.size(x) > 0) & ~bad).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    clean = staged(clean, "vectors")
    spark = vectors.sparkSession
    asked = clean.filter(F.col("id") % every == 0).dropDuplicates(["id"])
    blocks = max(1, -(-asked.count() // block))
    sample = clean.limit(SEED_ROWS).toArrow()
    seeds = [BallTree.build(matrix(c), i.to_numpy()) for i, c in zip(sample["id"].chunks, sample["v"].chunks, strict=True) if len(i)]

    def answers(ids: np.ndarray, scores: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        some = np.nonzero(scores != NONE)
        return pa.RecordBatch.from_arrays([pa.array(ids[some[0]]), pa.array(found[some]), pa.array(scores[some])], names=["query_id", "id", "score"])

    def search_block(number: int) -> DataFrame:
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow().combine_chunks()
        ids = rows["id"].to_numpy()
        queries = matrix(rows["v"].chunk(0)) if len(ids) else np.zeros((0, 1), np.int64)
        scores, found = np.full((len(ids), top), NONE), np.full((len(ids), top), np.iinfo(np.int64).max)
        for tree in seeds:
            tree.search(queries, ids, scores, found, scores[:, -1].copy())
        shared = spark.sparkContext.broadcast((ids, queries, scores[:, -1].copy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, floor = shared.value
            scores, found = np.full((len(ids), top), NONE), np.full((len(ids), top), np.iinfo(np.int64).max)
            for batch in batches:
                for at in range(0, batch.num_rows, SHARD):
                    part = batch.slice(at, SHARD)
                    tree = BallTree.build(matrix(part.column(1)), part.column(0).to_numpy())
                    tree.search(queries, ids, scores, found, floor)
            yield answers(ids, scores, found)

        return clean.mapInArrow(run, "query_id long, id long, score long")

    if blocks == 1:
        got = search_block(0)
    else:
        parts = [staged(search_block(n), "answers") for n in range(blocks)]
        got = parts[0]
        for part in parts[1:]:
            got = got.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    got = got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return got.select("query_id", "rank", F.col("id").alias(id_col), "score")
