"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task.
Here each key's order axis is cut into cells of a fixed width, and a cell that
still holds too many rows is cut again at approximate quantiles. Windows run
inside one slice; what must cross a slice border (previous row, last seen
value, running total) travels through one summary row per slice. The second
level sees as many rows per key as the key has slices, i.e. time span / width,
not as many as it has events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagledger.session import cut_lineage

CELL, PART = "_cell", "_part"


@dataclass(frozen=True)
class Slicing:
    """Cell width in units of the order column, and how to cut a hot cell again.

    At most ``total rows / max_rows`` cells are cut again, which bounds the
    broadcast cut table: 10^12 rows give 50 000 cells of 64 numbers (25 MB).
    ``tasks`` deals the rows of the windows to so many tasks; without it the
    session decides, which does not look at the number of rows.
    """

    width: float
    max_rows: int = 20_000_000
    parts: int = 64
    measured: bool = False
    cuts: DataFrame | None = None
    tasks: int | None = None


def dealt(df: DataFrame, by: Sequence[str], tasks: int | None) -> DataFrame:
    """Rows hashed by ``by`` into ``tasks`` partitions; as they are where the session decides."""
    return df if tasks is None else df.repartition(tasks, *by)


def dealt_slices(rows: DataFrame, own: Sequence[str], slicing: Slicing) -> DataFrame:
    """Slices of a measured slicing in its tasks. Without cuts the part is a constant, which Spark's windows leave out."""
    return dealt(rows, [*own, CELL] if slicing.cuts is None else [*own, CELL, PART], slicing.tasks)


def plain_keys(df: DataFrame, keys: Sequence[str], prefix: str = "_by") -> tuple[DataFrame, list[str]]:
    """Key columns for joins and windows alike, in which NULL equals NULL.

    A key that may be NULL becomes two columns, its value or a default and whether it is NULL; both are plain values, so
    sorting and hashing stay as cheap as on the key, and one partitioning serves the windows and the join. A key of a
    nested type becomes a struct round it, which compares NULL as a value.
    """
    made: dict[str, Column] = {}
    names: list[str] = []
    for i, key in enumerate(keys):
        field = df.schema[key]
        if not field.nullable:
            names.append(key)
            continue
        name = f"{prefix}{i}"
        default = _default(field.dataType)
        if default is None:
            made[name] = F.struct(F.col(key).alias("x"))
            names.append(name)
        else:
            made[name] = F.coalesce(F.col(key), default.cast(field.dataType))
            made[f"{name}n"] = F.col(key).isNull()
            names += [name, f"{name}n"]
    return (df.withColumns(made) if made else df), names


def given_keys(keys: Sequence[str], names: Sequence[str], prefix: str = "_by") -> list[Column]:
    """The keys again, from the columns of :func:`plain_keys`."""
    out = []
    for i, key in enumerate(keys):
        name = f"{prefix}{i}"
        if f"{name}n" in names:
            out.append(F.when(~F.col(f"{name}n"), F.col(name)).alias(key))
        else:
            out.append(F.col(f"{name}.x").alias(key) if name in names else F.col(key))
    return out


def _default(kind: T.DataType) -> Column | None:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.NumericType):
        return F.lit(0)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01")
    return None


def _with_few(df: DataFrame, few: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows with the columns of a small table of the same keys; NULL equals NULL."""
    there = few.withColumnsRenamed({k: f"_few_{k}" for k in keys})
    same = reduce(and_, [df[k].eqNullSafe(there[f"_few_{k}"]) for k in keys])
    return df.join(F.broadcast(there), same, how).drop(*[f"_few_{k}" for k in keys])


def _cell(order: Column | str, slicing: Slicing) -> Column:
    """Rows without an order value share one cell that comes first, as NULLs do in an ascending order."""
    order = F.col(order) if isinstance(order, str) else order
    return F.coalesce(F.floor(order / F.lit(slicing.width)).cast("long"), F.lit(-(1 << 63)))


def measure(df: DataFrame, keys: Sequence[str], order: str, slicing: Slicing) -> Slicing:
    """Count rows per cell and, only if some cell is too full, compute its cuts.

    One column-pruned count with map-side combine; ask once per stream and
    reuse the result in every scan over rows of that stream.
    """
    by = [*keys, CELL]
    seen = df.select(*keys, order).withColumn(CELL, _cell(order, slicing))
    hot = seen.groupBy(*by).count().filter(F.col("count") > slicing.max_rows).drop("count")
    if hot.isEmpty():
        return replace(slicing, measured=True, cuts=None)
    steps = [i / slicing.parts for i in range(1, slicing.parts)]
    cuts = (
        _with_few(seen, hot, by, "inner")
        .groupBy(*by)
        .agg(F.percentile_approx(order, steps, slicing.parts * 20).alias("_cuts"))
    )
    return replace(slicing, measured=True, cuts=cut_lineage(cuts))


def _part(order: Column) -> Column:
    return F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < order))).otherwise(F.lit(0))


def slice_rows(df: DataFrame, keys: Sequence[str], order: str, slicing: Slicing) -> DataFrame:
    """Add ``_cell`` and ``_part``: rows of one (key, cell, part) are contiguous in order."""
    if not slicing.measured:
        slicing = measure(df, keys, order, slicing)
    base = df.withColumn(CELL, _cell(order, slicing))
    if slicing.cuts is None:
        return base.withColumn(PART, F.lit(0))
    cut = _with_few(base, slicing.cuts, [*keys, CELL], "left")
    return cut.withColumn(PART, _part(F.col(order))).drop("_cuts")


def _ordering(order: str, ties: Sequence[str]) -> Column:
    return F.struct(F.col(order), *[F.col(t) for t in ties])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    slicing: Slicing,
    *,
    ties: Sequence[str] = (),
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    last_seen: Mapping[str, Column] | None = None,
    next_seen: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    running_max: Mapping[str, Column] | None = None,
    index: str | None = None,
) -> DataFrame:
    """Add order-dependent columns without putting a key into one task.

    ``before``/``after``: value on the neighbouring row. ``last_seen`` /
    ``next_seen``: nearest non-null value up to / from the row, itself
    included. A NULL key is a key of its own. ``running``: inclusive running sum. ``running_max``: maximum over
    the rows strictly before. ``index``: 0-based row number in the key.
    """
    before, after = dict(before or {}), dict(after or {})
    last_seen, next_seen = dict(last_seen or {}), dict(next_seen or {})
    running, running_max = dict(running or {}), dict(running_max or {})
    if index:
        running[index] = F.lit(1).cast("long")
    if not slicing.measured:
        slicing = measure(df, keys, order, slicing)
    rows, own = plain_keys(slice_rows(df, keys, order, slicing), keys)
    by = [*own, CELL, PART]
    rows = dealt_slices(rows, own, slicing)
    at = _ordering(order, ties)
    names = [*before, *after, *last_seen, *next_seen, *running, *running_max]
    inputs = {**before, **after, **last_seen, **next_seen, **running, **running_max}
    rows = rows.withColumns({f"_in_{n}": inputs[n] for n in names})

    forward = Window.partitionBy(*by).orderBy(order, *ties)
    backward = Window.partitionBy(*by).orderBy(F.desc(order), *[F.desc(t) for t in ties])
    upto = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = forward.rowsBetween(Window.unboundedPreceding, -1)
    down = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local: dict[str, Column] = {}
    edge: dict[str, Column] = {}
    for n in before:
        local[n] = F.lag(F.struct(F.col(f"_in_{n}").alias("v"))).over(forward)
        edge[n] = F.max_by(F.struct(F.col(f"_in_{n}").alias("v")), at)
    for n in after:
        local[n] = F.lead(F.struct(F.col(f"_in_{n}").alias("v"))).over(forward)
        edge[n] = F.min_by(F.struct(F.col(f"_in_{n}").alias("v")), at)
    for n in last_seen:
        value = F.col(f"_in_{n}")
        local[n] = F.last(value, ignorenulls=True).over(upto)
        edge[n] = F.max_by(value, F.when(value.isNotNull(), at))
    for n in next_seen:
        value = F.col(f"_in_{n}")
        local[n] = F.last(value, ignorenulls=True).over(down)
        edge[n] = F.min_by(value, F.when(value.isNotNull(), at))
    for n in running:
        local[n] = F.sum(f"_in_{n}").over(upto)
        edge[n] = F.sum(f"_in_{n}")
    for n in running_max:
        local[n] = F.max(f"_in_{n}").over(prior)
        edge[n] = F.max(f"_in_{n}")

    # Second level: one row per slice, so a key's rows here number span / width.
    across = Window.partitionBy(*own).orderBy(CELL, PART)
    across_back = Window.partitionBy(*own).orderBy(F.desc(CELL), F.desc(PART))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across_back.rowsBetween(Window.unboundedPreceding, -1)
    carry: dict[str, Column] = {}
    for n in before:
        carry[n] = F.lag(f"_edge_{n}").over(across)
    for n in after:
        carry[n] = F.lead(f"_edge_{n}").over(across)
    for n in last_seen:
        carry[n] = F.last(f"_edge_{n}", ignorenulls=True).over(earlier)
    for n in next_seen:
        carry[n] = F.last(f"_edge_{n}", ignorenulls=True).over(later)
    for n in running:
        carry[n] = F.sum(f"_edge_{n}").over(earlier)
    for n in running_max:
        carry[n] = F.max(f"_edge_{n}").over(earlier)
    borders = (
        rows.groupBy(*by)
        .agg(*[edge[n].alias(f"_edge_{n}") for n in names])
        .select(*by, *[carry[n].alias(f"_carry_{n}") for n in names])
    )

    out = rows.withColumns({f"_local_{n}": local[n] for n in names}).join(borders, by, "left")
    final: dict[str, Column] = {}
    for n in [*before, *after]:
        final[n] = F.coalesce(F.col(f"_local_{n}"), F.col(f"_carry_{n}"))["v"]
    for n in [*last_seen, *next_seen]:
        final[n] = F.coalesce(F.col(f"_local_{n}"), F.col(f"_carry_{n}"))
    for n in running:
        total = F.coalesce(F.col(f"_local_{n}"), F.lit(0)) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))
        final[n] = (total - 1).cast("long") if n == index else total
    for n in running_max:
        final[n] = F.greatest(F.col(f"_local_{n}"), F.col(f"_carry_{n}"))
    kept = [c for c in df.columns if c not in final]
    return out.select(*kept, *[final[n].alias(n) for n in names])


def halo_slices(
    df: DataFrame, keys: Sequence[str], order: str, slicing: Slicing, before: float, after: float
) -> DataFrame:
    """Copy rows near a slice border into the neighbouring slices.

    Every home row then finds all rows with order in [t - before, t + after]
    in its own (key, cell, part). ``_home`` marks the original; keep only those
    after the window. Copies per row are 1 + (before + after) / width for cold
    cells.
    """
    if not slicing.measured:
        slicing = measure(df, keys, order, slicing)
    t = F.col(order)
    # A row at t is needed by home rows between t - after and t + before.
    first, last = t - F.lit(after), t + F.lit(before)
    spread = df.withColumn("_base", _cell(t, slicing)).withColumn(
        CELL, F.explode(F.sequence(_cell(first, slicing), _cell(last, slicing)))
    )
    if slicing.cuts is None:
        return spread.withColumn(PART, F.lit(0)).withColumn("_home", F.col(CELL) == F.col("_base")).drop("_base")
    return (
        _with_few(spread, slicing.cuts, [*keys, CELL], "left")
        .withColumn(PART, F.explode(F.sequence(_part(first), _part(last))))
        .withColumn("_home", (F.col(CELL) == F.col("_base")) & (F.col(PART) == _part(t)))
        .drop("_cuts", "_base")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    slicing: Slicing,
    columns: Mapping[str, tuple[str, float, float]],
) -> DataFrame:
    """Add aggregates over value frames: ``{name: (sql aggregate, lower, upper)}``.

    Bounds are offsets on the (integer) order column, as in ``rangeBetween``.
    """
    reach_back = max(0, *[-int(lo) for _, lo, _ in columns.values()])
    reach_on = max(0, *[int(hi) for _, _, hi in columns.values()])
    rows = halo_slices(df, keys, order, slicing, reach_back, reach_on)
    seq = Window.partitionBy(*keys, CELL, PART).orderBy(order)
    made = {
        name: F.expr(aggregate).over(seq.rangeBetween(int(lo), int(hi)))
        for name, (aggregate, lo, hi) in columns.items()
    }
    return rows.withColumns(made).filter("_home").drop(CELL, PART, "_home")


def row_framed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    slicing: Slicing,
    columns: Mapping[str, tuple[Column, int, int]],
    ties: Sequence[str] = (),
    block: int = 100_000,
) -> DataFrame:
    """Aggregates over row frames ``{name: (aggregate, first offset, last offset)}``.

    Rows get a dense index first; blocks of equal size with a halo of a few
    rows are then balanced whatever the time distribution.
    """
    back = max(0, *[-lo for _, lo, _ in columns.values()])
    on = max(0, *[hi for _, _, hi in columns.values()])
    at = F.col("_row")
    rows = (
        scan(df, keys, order, slicing, ties=ties, index="_row")
        .withColumn("_own", F.floor(at / block))
        .withColumn(
            "_block",
            F.explode(F.sequence(F.floor((at - on) / block), F.floor((at + back) / block))),
        )
    )
    seq = Window.partitionBy(*keys, "_block").orderBy("_row")
    made = {name: agg.over(seq.rowsBetween(lo, hi)) for name, (agg, lo, hi) in columns.items()}
    return rows.withColumns(made).filter(F.col("_block") == F.col("_own")).drop("_row", "_own", "_block")


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    slicing: Slicing,
    label: Column,
    *,
    ties: Sequence[str] = (),
    name: str = "run_id",
) -> DataFrame:
    """Number maximal stretches of equal ``label`` (NULL equals NULL) per key, from 1.

    Every row stays: NULL keys are a key of their own, and rows without an order value come first. Keys are compared as
    one struct, in which NULL equals NULL, so windows and join share one partitioning.
    """
    by = ["_keys", CELL, PART]
    at = _ordering(order, ties)
    seq = Window.partitionBy(*by).orderBy(order, *ties)
    rows = slice_rows(df.withColumn("_label", F.struct(label.alias("x"))), keys, order, slicing)
    rows = rows.withColumn("_keys", F.struct(F.lit(0).alias("_"), *keys))
    rows = rows.withColumn("_starts", F.when(F.lag("_label").over(seq).eqNullSafe(F.col("_label")), 0).otherwise(1))
    rows = rows.withColumn(
        "_local", F.sum("_starts").over(seq.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    # A slice whose first label continues the slice before has one start too many.
    across = Window.partitionBy("_keys").orderBy(CELL, PART)
    borders = (
        rows.groupBy(*by)
        .agg(F.min_by("_label", at).alias("_first"), F.max_by("_label", at).alias("_last"), F.sum("_starts").alias("_n"))
        .withColumn("_own", F.col("_n") - F.lag("_last").over(across).eqNullSafe(F.col("_first")).cast("int"))
        .select(*by, (F.sum("_own").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"))
    )
    return (
        rows.join(borders, by)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_keys", CELL, PART, "_label", "_starts", "_local", "_offset")
    )


def global_index(
    df: DataFrame, order: str, slicing: Slicing, *, ties: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """0-based position of every row in one total order, counted slice by slice."""
    return scan(df, [], order, slicing, ties=ties, index=name)
