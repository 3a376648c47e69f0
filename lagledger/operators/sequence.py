"""Row-order operators on frame and event streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagledger.functions.numeric import finite
from lagledger.functions.vectors import mean_abs_difference
from lagledger.operators.rules import passes, reasons
from lagledger.operators.scan import Slicing, row_framed, runs, scan
from lagledger.session import cut_lineage


@dataclass(frozen=True)
class MouthLimits:
    """Fixed values of the visual rules."""

    closed_median: float = 0.015
    closed_maximum: float = 0.025
    open_median: float = 0.035
    spread: float = 0.020
    width_px: float = 80.0
    quality: float = 0.25
    width_jump: float = 0.15
    filter_frames: int = 3
    confirmations: int = 2
    confirm_within: float = 0.180
    closure_minimum: float = 0.080
    closure_maximum: float = 0.600
    search_before: float = 0.300
    search_after: float = 0.350
    release_gap: float = 0.110
    freeze: float = 0.125


def jump_flags(
    df: DataFrame, keys: Sequence[str], order: str, value: str, fraction: float, slicing: Slicing,
    *, ties: Sequence[str] = (), name: str = "jump",
) -> DataFrame:
    """Mark both rows of a neighbouring pair whose relative change is above ``fraction``.

    A pair with a NULL or a value that is not above 0 is skipped.
    """
    wide = scan(
        df, keys, order, slicing, ties=ties,
        before={"_was": F.col(value)}, after={"_next": F.col(value)},
    )
    change = lambda a, b: (a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b, F.lit(1e-9)) > fraction)
    here = F.col(value)
    flag = F.coalesce(change(here, F.col("_was")), F.lit(False)) | F.coalesce(
        change(here, F.col("_next")), F.lit(False)
    )
    return wide.withColumn(name, flag).drop("_was", "_next")


def centered_median(
    df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, slicing: Slicing,
    *, ties: Sequence[str] = (), name: str = "centered_median",
) -> DataFrame:
    """Median over an odd number of rows, cut at the ends, NULL with fewer than width // 2 + 1 values."""
    if width % 2 != 1:
        raise ValueError("width must be odd")
    h = width // 2
    out = row_framed(
        df, keys, order, slicing, ties=ties,
        columns={name: (F.percentile(value, 0.5), -h, h), "_seen": (F.count(value), -h, h)},
    )
    return out.withColumn(name, F.when(F.col("_seen") >= h + 1, F.col(name))).drop("_seen")


def run_table(
    df: DataFrame, keys: Sequence[str], order: str, slicing: Slicing, label: Column, *, ties: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per maximal run of equal label: first and last order value, rows, label."""
    numbered = runs(df.withColumn("label", label), keys, order, slicing, F.col("label"), ties=ties)
    return numbered.groupBy(*keys, "run_id", "label").agg(
        F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_rows"), *extra
    )


def frame_quality(
    samples: DataFrame, keys: Sequence[str], order: str, slicing: Slicing, limits: MouthLimits, *, ties: Sequence[str] = ()
) -> DataFrame:
    """Reasons per frame, ``quality_valid`` (no reason) and ``usable`` (valid and not repeated)."""
    flagged = jump_flags(samples, keys, order, "mouth_width_px", limits.width_jump, slicing, ties=ties, name="width_jump")
    numbers = ["median_aperture", "maximum_aperture", "aperture_spread", "mouth_width_px", "face_quality"]
    missing = F.lit(False)
    for n in numbers:
        missing = missing | finite(n).isNull()
    rules = reasons(
        (~F.coalesce("face_detected", F.lit(False)), "face_not_detected"),
        (missing, "nonfinite_mouth_geometry"),
        (F.col("mouth_width_px") < limits.width_px, "mouth_resolution_too_low"),
        (F.col("aperture_spread") > limits.spread, "inconsistent_lip_landmarks"),
        (F.col("face_quality") < limits.quality, "low_face_quality"),
        (F.col("width_jump"), "mouth_width_jump"),
    )
    return (
        flagged.withColumn("quality_reasons", rules)
        .withColumn("quality_valid", passes("quality_reasons"))
        .withColumn("usable", F.col("quality_valid") & ~F.coalesce("repeated_frame", F.lit(False)))
    )


def mouth_state(median, maximum, limits: MouthLimits, usable: Column | None = None) -> Column:
    """closed/contact, open or transition; NULL when not usable."""
    state = (
        F.when((F.col(median) <= limits.closed_median) & (F.col(maximum) <= limits.closed_maximum), "closed/contact")
        .when(F.col(median) >= limits.open_median, "open")
        .otherwise("transition")
    )
    known = F.col(median).isNotNull() & F.col(maximum).isNotNull()
    return F.when(known if usable is None else known & usable, state)


def contact_open_edges(window: DataFrame, event: str, time: str, *, max_gap: float, scale: float = 1.0) -> DataFrame:
    """Contact-to-open edges inside each event's window.

    ``window`` has one row per (event, usable frame) with ``state`` and
    ``audio_time``; the window length bounds an event's rows. The last contact
    then the first open within ``max_gap`` make an edge at the midpoint;
    transitions between them do not matter, an open or a longer gap ends it.
    """
    seq = Window.partitionBy(event).orderBy(time)
    prior = seq.rowsBetween(Window.unboundedPreceding, -1)
    contact, opened = F.col("state") == "closed/contact", F.col("state") == "open"
    t = F.col(time)
    marked = window.withColumns(
        {
            "_contact": F.last(F.when(contact, t), ignorenulls=True).over(prior),
            "_open": F.last(F.when(opened, t), ignorenulls=True).over(prior),
            "_start": (
                contact
                & ~F.coalesce(
                    (F.lag("state").over(seq) == "closed/contact") & (t - F.lag(t).over(seq) <= max_gap), F.lit(False)
                )
            ).cast("int"),
        }
    ).withColumn("_run", F.sum("_start").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(event, "_run").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_length", F.count(F.when(contact, 1)).over(in_run))
    gap = t - F.col("_contact")
    edge = opened & (F.col("_open").isNull() | (F.col("_contact") > F.col("_open"))) & (gap > 0) & (gap <= max_gap)
    middle = (F.col("_contact") + t) * F.lit(0.5)
    return marked.filter(edge).select(
        event, "audio_time", F.col("_contact").alias("contact_time"), t.alias("open_time"), middle.alias("edge_time"),
        ((middle - F.col("audio_time")) * F.lit(scale)).alias("edge_lag"), F.col("_length").alias("contact_run"),
    )


def nearest_edge(edges: DataFrame, event: str) -> DataFrame:
    """The edge nearest to the audio time (tie: earlier) and how many there were."""
    rank = F.struct(F.abs("edge_lag"), F.col("edge_time"))
    value = F.struct(*[F.col(c) for c in edges.columns if c != event])
    return edges.groupBy(event).agg(
        F.min_by(value, rank).alias("edge"), F.count(F.lit(1)).alias("edge_count")
    ).withColumn("ambiguous_multiple_edges", F.col("edge_count") > 1)


def cadence(
    frames: DataFrame, keys: Sequence[str], pts: str, order: str, period: float, slicing: Slicing
) -> DataFrame:
    """Timing regularity per key; constant rate only if nothing is off.

    ``order`` is decode order, ``pts`` the time stamp (may be NULL).
    """
    limit = max(1e-6, 0.02 * period)
    timed = scan(
        frames.filter(F.col(pts).isNotNull()), keys, order, slicing, before={"_was": F.col(pts)}
    ).withColumn("_gap", F.col(pts) - F.col("_was"))
    from lagledger.operators.quantiles import quantiles

    off = F.abs(F.col("_gap") - F.lit(period))
    table = quantiles(
        timed, keys, "_gap", {"median_interval": 0.5},
        extra=[
            F.count("_gap").alias("interval_count"), F.count_if(F.col("_gap") <= 0).alias("non_positive_count"),
            F.count_if(off > limit).alias("outlier_count"), F.max(off).alias("max_deviation"),
        ],
    )
    missing = frames.groupBy(*keys).agg(F.count_if(F.col(pts).isNull()).alias("missing_pts_count"))
    clean = (F.col("outlier_count") == 0) & (F.col("non_positive_count") == 0) & (F.col("missing_pts_count") == 0)
    return (
        missing.join(table, list(keys), "left")
        .fillna(0, subset=["interval_count", "non_positive_count", "outlier_count"])
        .withColumn("outlier_fraction", F.coalesce(F.try_divide(F.col("outlier_count"), F.col("interval_count")), F.lit(1.0)))
        .withColumn("constant_rate", clean & (F.col("interval_count") >= 1))
    )


def native_coverage(
    windows: DataFrame, event: str, time: str, start: str, end: str, phase: str, period: float, tolerance: float
) -> DataFrame:
    """Expected against present native frames per event window, with reasons. Nothing is interpolated.

    ``windows``: one row per (event, frame or NULL) with the window bounds and
    the grid phase repeated on each row.
    """
    seq = Window.partitionBy(event).orderBy(time)
    gaps = windows.withColumn("_gap", F.col(time) - F.lag(time).over(seq))
    first = F.ceil((F.col(start) - F.col(phase) - tolerance) / period)
    last = F.floor((F.col(end) - F.col(phase) + tolerance) / period)
    table = gaps.groupBy(event, start, end, phase).agg(
        F.count(time).alias("frame_count"), F.min(time).alias("_first"), F.max(time).alias("_last"),
        F.when(F.count(time) > 0, F.coalesce(F.max("_gap"), F.lit(0))).alias("maximum_gap"),
    ).withColumn("expected_count", F.greatest(F.lit(1), last - first + 1).cast("long"))
    table = table.withColumns(
        {
            "start_gap": F.when(F.col("frame_count") > 0, F.greatest(F.lit(0), F.col("_first") - F.col(start))),
            "end_gap": F.when(F.col("frame_count") > 0, F.greatest(F.lit(0), F.col(end) - F.col("_last"))),
        }
    )
    rules = reasons(
        (F.col("frame_count") < F.col("expected_count"), "insufficient_native_frame_coverage"),
        (F.col("start_gap").isNull() | (F.col("start_gap") > period + tolerance), "missing_preclosure_window_coverage"),
        (F.col("end_gap").isNull() | (F.col("end_gap") > period + tolerance), "missing_postrelease_window_coverage"),
        (F.col("maximum_gap") > 1.5 * period + tolerance, "native_frame_gap_in_closure_window"),
    )
    return table.withColumn("coverage_reasons", rules).drop("_first", "_last")


def repeated_frames(
    df: DataFrame, keys: Sequence[str], order: str, vector: str, slicing: Slicing, threshold: float = 0.0015
) -> DataFrame:
    """Frames that hardly differ from the one before; the first frame or a size change is never repeated."""
    out = scan(df, keys, order, slicing, before={"_was": F.col(vector)})
    return (
        out.withColumn("repeat_distance", mean_abs_difference(vector, "_was"))
        .withColumn("repeated_frame", F.coalesce(F.col("repeat_distance") <= threshold, F.lit(False)))
        .drop("_was")
    )


def scene_segments(
    df: DataFrame, keys: Sequence[str], order: str, vector: str, slicing: Slicing, threshold: float = 0.08
) -> DataFrame:
    """A mean absolute change of at least ``threshold`` starts a new segment (numbered from 0)."""
    marked = scan(df, keys, order, slicing, before={"_was": F.col(vector)}).withColumn(
        "_cut", F.coalesce((mean_abs_difference(vector, "_was") >= threshold).cast("int"), F.lit(0))
    )
    # A scan reads its input twice; between two scans the rows are kept.
    marked = cut_lineage(marked)
    return scan(marked, keys, order, slicing, running={"segment": F.col("_cut")}).drop("_was", "_cut")


def freeze_before(
    df: DataFrame, keys: Sequence[str], order: str, slicing: Slicing, repeated: str = "repeated_frame", name: str = "freeze"
) -> DataFrame:
    """Length of the repeated stretch that ends on the row before, counted from the frame it repeats."""
    rows = scan(
        df, keys, order, slicing, index="_row",
        before={"_was": F.col(order), "_was_repeated": F.col(repeated)},
    )
    # The row before is the start of a stretch if it is fresh or the very first.
    start = F.when(~F.col("_was_repeated") | (F.col("_row") == 1), F.col("_was"))
    held = scan(cut_lineage(rows), keys, order, slicing, last_seen={"_anchor": start})
    span = F.greatest(F.lit(0), F.col("_was") - F.col("_anchor"))
    return held.withColumn(
        name, F.when(F.coalesce("_was_repeated", F.lit(False)), span).otherwise(F.lit(0))
    ).drop("_was", "_was_repeated", "_row", "_anchor")


def rewrite_runs(
    df: DataFrame, keys: Sequence[str], order: str, mask: str, slicing: Slicing, *, close_up_to: int = 0, drop_below: int = 0
) -> DataFrame:
    """Fill inner false runs of at most ``close_up_to`` rows, or remove true runs below ``drop_below`` rows."""
    numbered = cut_lineage(runs(df, keys, order, slicing, F.col(mask)))
    sizes = numbered.groupBy(*keys, "run_id").agg(F.count(F.lit(1)).alias("_size"))
    ends = sizes.groupBy(*keys).agg(F.max("run_id").alias("_last"))
    out = numbered.join(sizes.join(ends, list(keys)), [*keys, "run_id"])
    m = F.col(mask)
    if close_up_to:
        inner = (F.col("run_id") > 1) & (F.col("run_id") < F.col("_last"))
        m = m | (inner & (F.col("_size") <= close_up_to))
    if drop_below:
        m = m & (F.col("_size") >= drop_below)
    return out.withColumn(mask, m).drop("run_id", "_size", "_last")


def covered_spans(
    df: DataFrame, keys: Sequence[str], order: str, observed: Column, step: float, slicing: Slicing
) -> DataFrame:
    """Maximal observed stretches as half-open spans [first, last + step)."""
    table = run_table(df, keys, order, slicing, observed)
    return table.filter("label").select(
        *keys, F.col("run_start").alias("start"), (F.col("run_end") + F.lit(step)).alias("end"), "run_rows"
    )


def downsample_due(
    df: DataFrame, keys: Sequence[str], order: str, pts: str, period: float, slicing: Slicing
) -> DataFrame:
    """One real frame per due instant: the first that reaches it.

    ``order`` is decode order. Frames that do not move time forward are left
    out; due instants are start + i * period, and a frame that crosses several
    of them is emitted once.
    """
    forward = scan(df, keys, order, slicing, running_max={"_high": F.col(pts)}).filter(
        F.col(pts).isNotNull() & (F.col("_high").isNull() | (F.col(pts) > F.col("_high")))
    )
    starts = df.groupBy(*keys).agg(F.min_by(pts, F.when(F.col(pts).isNotNull(), F.col(order))).alias("_t0"))
    binned = forward.join(starts, list(keys)).withColumn(
        "due_index", F.floor((F.col(pts) - F.col("_t0")) / period).cast("long")
    )
    firsts = binned.groupBy(*keys, "due_index").agg(F.min(F.struct(pts, order)).alias("_first"))
    return firsts.select(*keys, "due_index", F.col(f"_first.{pts}").alias(pts), F.col(f"_first.{order}").alias(order))


def sorted_unique_violations(df: DataFrame, keys: Sequence[str], order: str, time: str, slicing: Slicing) -> DataFrame:
    """Rows whose time is missing or not later than the row before (in sorted order: duplicates)."""
    timed = df.filter(finite(time).isNotNull())
    marked = scan(timed, keys, time, slicing, ties=[order], before={"_was": F.col(time)})
    return marked.filter(F.col("_was") >= F.col(time)).drop("_was")


def overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, ident: str, slicing: Slicing) -> DataFrame:
    """Intervals that start before an earlier one has ended (nesting included)."""
    marked = scan(df, keys, start, slicing, ties=[end, ident], running_max={"_high": F.col(end)})
    return marked.filter(F.col(start) < F.col("_high") - F.lit(1e-9)).withColumnRenamed("_high", "earlier_end")
