"""Scalar numeric expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND_DIGITS = 6


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def micros(ts) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column (UTC session)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def r6(value) -> Column:
    """Round for comparison across engines."""
    return F.round(col(value), ROUND_DIGITS)


def finite(value) -> Column:
    """DOUBLE if the value is castable and finite, else NULL."""
    number = col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(math.inf)), number)


def strict_finite(value, data_type: str) -> Column:
    """Like :func:`finite`, but only for columns already stored as numbers.

    ``data_type`` is the column's stored type; booleans and strings never pass.
    """
    if data_type not in {"double", "float", "int", "integer", "bigint", "long", "smallint", "short", "tinyint", "byte"}:
        return F.lit(None).cast("double")
    return finite(value)


def positive_count(value) -> Column:
    """BIGINT if the value is a whole number above zero, else NULL."""
    number = finite(value)
    return F.when((number > 0) & (number == F.floor(number)), number.cast("long"))


def dbfs(rms, floor: float = 1e-12) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(col(rms).cast("double"), F.lit(floor)))


def hz_to_mel(hz) -> Column:
    return F.lit(2595.0) * F.log10(F.lit(1.0) + col(hz) / F.lit(700.0))


def mel_to_hz(mel) -> Column:
    return F.lit(700.0) * (F.pow(F.lit(10.0), col(mel) / F.lit(2595.0)) - F.lit(1.0))


def lag_ms(visual_s, acoustic_s) -> Column:
    """Positive when the visual event comes after the acoustic one."""
    return (col(visual_s) - col(acoustic_s)) * F.lit(1000.0)


def lag_uncertainty_ms(resolution_ms, visual_uncertainty_ms) -> Column:
    return F.hypot(col(resolution_ms) / F.lit(2.0), col(visual_uncertainty_ms))


def edge_distance(t, start, end) -> Column:
    """0 inside the closed span, else the distance to the nearer edge; NULL span gives NULL."""
    t, start, end = col(t), col(start), col(end)
    return F.when(
        start.isNotNull() & end.isNotNull(),
        F.greatest(F.lit(0.0), start - t, t - end),
    )


def position_score(raw, offset_ms) -> Column:
    """Raw score less a penalty for the distance to an offset of 45 ms."""
    return col(raw) - F.lit(0.80) * F.abs((col(offset_ms) - F.lit(45.0)) / F.lit(150.0))


def raw_score(slope_z, rise_z, high_z, flux_z) -> Column:
    return (
        F.lit(0.95) * col(slope_z)
        + F.lit(0.70) * col(rise_z)
        + F.lit(0.45) * col(high_z)
        + F.lit(0.35) * col(flux_z)
    )


def clip(value, low: float, high: float) -> Column:
    value = col(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def bbox_area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def bbox_iou(a, b) -> Column:
    """Intersection over union of two ``[x0, y0, x1, y1]`` arrays; union floor 1e-9."""
    a, b = col(a), col(b)
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    overlap = wide * high
    union = F.greatest(F.lit(0.0), bbox_area(a)) + F.greatest(F.lit(0.0), bbox_area(b)) - overlap
    return overlap / F.greatest(union, F.lit(1e-9))


def bbox_diagonal(box) -> Column:
    box = col(box)
    return F.hypot(box[2] - box[0], box[3] - box[1])


def size_change(a, b) -> Column:
    floor = F.lit(1e-9)
    return F.abs(F.ln(F.greatest(bbox_area(col(b)), floor) / F.greatest(bbox_area(col(a)), floor)))


def direction(lag, margin_ms: float) -> Column:
    """Signed lag to a label; exactly on the margin still counts as near."""
    lag = col(lag)
    return (
        F.when(lag.isNull(), "unavailable")
        .when(lag < -F.lit(margin_ms), "video_leads")
        .when(lag > F.lit(margin_ms), "video_lags")
        .otherwise("near")
    )


def designated_relations(low, high, middle, designated) -> dict[str, Column]:
    """Descriptive relation of one value to a group's range; all NULL when a side is missing."""
    low, high, middle, designated = map(col, (low, high, middle, designated))
    known = low.isNotNull() & high.isNotNull() & middle.isNotNull() & designated.isNotNull()
    return {
        "inside_range": F.when(known, (designated >= low) & (designated <= high)),
        "signed_delta": F.when(known, middle - designated),
        "absolute_delta": F.when(known, F.abs(middle - designated)),
    }


def timeline_origin(container_start, stream_starts) -> Column:
    """Container start, else the earliest stream start, else zero."""
    return F.coalesce(col(container_start), F.array_min(F.array_compact(col(stream_starts))), F.lit(0.0))


def timeline_duration(container_duration, stream_ends, origin) -> Column:
    """Container duration, else the latest stream end less the origin."""
    return F.coalesce(
        col(container_duration), F.array_max(F.array_compact(col(stream_ends))) - col(origin)
    )


def scope_end(duration, requested, start=None, *, strict: bool = True) -> Column:
    """Requested end if it lies in (0, duration + 1 µs] and after ``start``; default is the whole duration.

    A bad end fails the query, or is NULL where ``strict`` is off.
    """
    duration, requested = col(duration), col(requested)
    end = F.coalesce(requested, duration)
    good = finite(end).isNotNull() & (end > (F.lit(0.0) if start is None else F.greatest(F.lit(0.0), col(start)))) & (end <= duration + F.lit(1e-6))
    bad = F.raise_error(F.lit("scope end outside the recording")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.coalesce(good, F.lit(False)), F.least(end, duration)).otherwise(bad)
