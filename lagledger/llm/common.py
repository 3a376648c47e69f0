"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagledger.session import shared_folder

#: Java and DuckDB agree on this class: every run without a space, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 52


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def draw(*parts: Column | str | int) -> Column:
    """A uniform integer below 2^52 from the parts; the same on every cluster and in SQL."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, HASH_BITS // 4), 16, 10).cast("long")


def key_of(column: Column) -> Column:
    """A grouping key without nulls: a null gets a key that no value has."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def own_names(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run(docs, ...)`` whatever the columns of ``docs`` are called.

    Columns named like those used inside (two underscores first) or with a dot get another name on the way in and their own
    one back on the way out; arguments that name such a column follow.
    """

    @wraps(run)
    def with_free_names(docs: DataFrame, *args, **options) -> DataFrame:
        mark = "given"
        while any(c.lower().startswith(mark) for c in docs.columns):
            mark += "_"
        free = {c: f"{mark}{k}" for k, c in enumerate(docs.columns) if c.startswith("__") or "." in c}
        follow = lambda x: free.get(x, x) if isinstance(x, str) else x
        out = run(docs.toDF(*[free.get(c, c) for c in docs.columns]), *map(follow, args), **{k: follow(v) for k, v in options.items()})
        back = {v: k for k, v in free.items()}
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return with_free_names


def cells_for(rows: int, per_cell: int = 2_000, most: int = 1 << 16) -> int:
    """Into how many hash cells an order is cut so that one window never sees more than a small share of the rows."""
    return max(1, min(most, -(-rows // per_cell)))


def running(df: DataFrame, keys: list[str], cell: str, order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Adds, for each (name, amount), the sum over all earlier rows of the same keys in the order (cell, *order).

    ``cell`` must rise with ``order``. Only one summary row per (keys, cell) is ordered within the keys; the rows
    themselves are ordered within their cell, so a key with a third of all rows is spread over its cells.
    """
    names = list(amounts)
    df = df.withColumns({f"__amount_{n}": c for n, c in amounts.items()})
    before = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    before = before.partitionBy(*keys) if keys else before
    offsets = df.groupBy(*keys, cell).agg(*[F.sum(f"__amount_{n}").alias(f"__sum_{n}") for n in names])
    offsets = offsets.select(*keys, cell, *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__from_{n}") for n in names])
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, [*keys, cell])
    out = out.withColumns({n: F.col(f"__from_{n}") + F.coalesce(F.sum(f"__amount_{n}").over(inside), F.lit(0)) for n in names})
    return out.drop(*[f"__{p}_{n}" for n in names for p in ("amount", "from")])


def modest_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts go to Python at most ``rows`` at a time: each worker, and the buffers of its task, hold one such batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name, "10000"))
    if held <= 0 or held > rows:
        spark.conf.set(name, rows)


_CACHES: dict[str, Callable[[], object]] = {}


def cached(name: str, drop: Callable[[], object]) -> None:
    """Announces what a worker keeps between tasks for the kernels called ``name``, and how to drop it."""
    _CACHES[name] = drop


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel`` for mapInArrow in a worker that other kernels use too: their caches go first, freed memory goes back at the end.

    Spark keeps Python workers from stage to stage; without this each holds what every kernel so far has kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, drop in _CACHES.items():
            if name != keeps:
                drop()
        _give_back()
        yield from kernel(batches)
        _give_back()

    return run


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the folder that all executors share and reads it back: columnar, prunable, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
