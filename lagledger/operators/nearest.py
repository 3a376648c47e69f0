"""Nearest, as-of, grid and interval matching without a cross product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagledger.operators.scan import CELL, PART, Slicing, dealt_slices, measure, plain_keys, slice_rows


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    slicing: Slicing,
    *,
    tie: str,
    direction: str = "nearest",
    max_distance: float | None = None,
    strict: bool = False,
    out: str = "match",
) -> DataFrame:
    """Attach to each left row the right row of the same key nearest in time.

    Ties go to the earlier row, equal times to the smaller ``tie``. The match
    is a struct column ``out`` (NULL where nothing qualifies). Both inputs are
    merged into one ordered stream, so work is linear in rows and no pairs are
    formed. A NULL key is a key of its own. ``direction`` is ``nearest``, ``backward`` or ``forward``;
    ``strict`` leaves out rows at the very same time.
    """
    side = "_right"
    payload = F.struct(F.col(time).alias(time), *[F.col(c) for c in right.columns if c not in {*keys, time}])
    lefts = left.select(
        *keys, F.col(time), F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
        F.lit(None).cast("long").alias("_tie"),
    )
    rights = right.select(*keys, F.col(time), payload.alias(side), F.col(tie).cast("long").alias("_tie"))
    merged = lefts.unionByName(rights, allowMissingColumns=True)
    if not slicing.measured:
        slicing = measure(merged, keys, time, slicing)
    rows, own = plain_keys(slice_rows(merged, keys, time, slicing), keys)
    by = [*own, CELL, PART]
    rows = dealt_slices(rows, own, slicing)
    # Right rows come first at equal times (their tie is not NULL), the smallest
    # tie last, so "last seen" is the wanted one. strict puts them after.
    if strict:
        order_on = [F.asc(time), F.desc_nulls_first("_tie")]
        order_back = [F.desc(time), F.desc_nulls_first("_tie")]
    else:
        order_on = [F.asc(time), F.desc_nulls_last("_tie")]
        order_back = [F.desc(time), F.desc_nulls_last("_tie")]
    on = Window.partitionBy(*by).orderBy(*order_on).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*by).orderBy(*order_back).rowsBetween(Window.unboundedPreceding, 0)
    present = F.col(side).isNotNull()
    wants_back = direction in {"nearest", "backward"}
    wants_on = direction in {"nearest", "forward"}

    edges, carries, locals_ = [], [], {}
    across = Window.partitionBy(*own).orderBy(CELL, PART).rowsBetween(Window.unboundedPreceding, -1)
    across_back = (
        Window.partitionBy(*own).orderBy(F.desc(CELL), F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    )
    if wants_back:
        locals_["_earlier"] = F.last(side, ignorenulls=True).over(on)
        edges.append(F.max_by(side, F.when(present, F.struct(F.col(time), -F.col("_tie")))).alias("_e"))
        carries.append(F.last("_e", ignorenulls=True).over(across).alias("_ce"))
    if wants_on:
        locals_["_later"] = F.last(side, ignorenulls=True).over(back)
        edges.append(F.min_by(side, F.when(present, F.struct(F.col(time), F.col("_tie")))).alias("_f"))
        carries.append(F.last("_f", ignorenulls=True).over(across_back).alias("_cf"))
    borders = rows.groupBy(*by).agg(*edges).select(*by, *carries)
    joined = rows.withColumns(locals_).filter(F.col("_l").isNotNull()).join(borders, by, "left")

    t = F.col(time)
    if wants_back:
        joined = joined.withColumn("_earlier", F.coalesce("_earlier", "_ce"))
    if wants_on:
        joined = joined.withColumn("_later", F.coalesce("_later", "_cf"))
    if direction == "backward":
        chosen: Column = F.col("_earlier")
    elif direction == "forward":
        chosen = F.col("_later")
    else:
        gap_back = t - F.col("_earlier")[time]
        gap_on = F.col("_later")[time] - t
        chosen = F.when(gap_on.isNull() | (gap_back <= gap_on), F.col("_earlier")).otherwise(F.col("_later"))
    if max_distance is not None:
        chosen = F.when(F.abs(chosen[time] - t) <= F.lit(max_distance), chosen)
    return joined.select("_l.*", chosen.alias(out))


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    slicing: Slicing,
    *,
    tie: str,
    guard: float = 0.0,
    out: str = "interval",
) -> DataFrame:
    """Half-open membership in disjoint intervals of the same key.

    ``placement`` is ``outside``, ``near_transition`` (within ``guard`` of
    either edge; still matched) or ``inside``. Since intervals do not overlap,
    the only one that can hold a point is the latest that starts at or before it.
    """
    starts = intervals.withColumn(time, F.col(start).cast(points.schema[time].dataType))
    found = nearest_join(points, starts, keys, time, slicing, tie=tie, direction="backward", out="_iv")
    t = F.col(time)
    held = F.when(t < F.col("_iv")[end], F.col("_iv"))
    near = ((t - held[start]) < F.lit(guard)) | ((held[end] - t) <= F.lit(guard))
    return (
        found.withColumn(out, held)
        .withColumn(
            "placement",
            F.when(F.col(out).isNull(), "outside").when(near, "near_transition").otherwise("inside"),
        )
        .drop("_iv")
    )


def window_join(
    events: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    event_time: str,
    sample_time: str,
    before: float,
    after: float,
    *,
    how: str = "inner",
) -> DataFrame:
    """Samples in the closed interval [event - before, event + after] of the same key.

    Range join as an equi-join on time buckets: an event visits every bucket
    its window touches, a sample sits in one, so each pair is met once. The
    output is the pairs themselves; AQE splits a bucket with too many samples.
    ``how="left"`` adds one row with NULL sample columns for every event.
    """
    width = F.lit(max(before + after, 1e-9))
    bucket = lambda value: F.floor(value / width).cast("long")
    e = F.col(event_time)
    left = events.withColumn(
        "_bucket", F.explode(F.sequence(bucket(e - F.lit(before)), bucket(e + F.lit(after))))
    )
    right = samples.withColumn("_bucket", bucket(F.col(sample_time)))
    inside = (F.col(sample_time) >= e - F.lit(before)) & (F.col(sample_time) <= e + F.lit(after))
    pairs = left.join(right, [*keys, "_bucket"]).filter(inside).drop("_bucket")
    if how == "inner":
        return pairs
    # One row without a sample per event: window aggregates ignore it, and an
    # event without samples keeps zero or NULL ones. No second pass over pairs.
    names = [c for c in pairs.columns if c not in events.columns]
    return pairs.unionByName(events, allowMissingColumns=True).select(*events.columns, *names)


def grid_nearest(
    frames: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, step: int, slicing: Slicing, *, tie: str
) -> DataFrame:
    """Nearest native frame for every instant of a regular grid.

    ``spans`` holds one row per key with integer ``start`` and ``stop`` (grid
    from start to stop, both kept, every ``step``). The grid is generated on
    the executors.
    """
    grid = spans.select(
        *keys,
        F.posexplode(F.sequence(F.col("start"), F.col("stop"), F.lit(step).cast("long"))).alias("grid_index", time),
    )
    return nearest_join(grid, frames, keys, time, slicing, tie=tie, out="frame")
