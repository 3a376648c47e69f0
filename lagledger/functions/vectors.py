"""Expressions on ARRAY<DOUBLE> columns (higher-order functions, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagledger.functions.numeric import clip, col


def doubles(values) -> Column:
    return col(values).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def rms(values: Column) -> Column:
    return F.sqrt(dot(values, values) / F.size(values))


def cosine_distance(a, b) -> Column:
    """1 - clipped cosine; NULL for empty vectors, unequal lengths or a zero norm."""
    a, b = doubles(a), doubles(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (norm > 0), F.lit(1.0) - clip(dot(a, b) / norm, -1.0, 1.0))


def mean_abs_difference(a, b) -> Column:
    """Mean |a - b|; NULL when a side is missing or lengths differ."""
    a, b = doubles(a), doubles(b)
    return F.when(
        (F.size(a) == F.size(b)) & (F.size(a) > 0),
        total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a),
    )


def three_pair_stats(values) -> dict[str, Column]:
    """Median, maximum and range of three paired measurements."""
    ordered = F.array_sort(doubles(values))
    return {
        "pair_median": ordered[1],
        "pair_maximum": ordered[2],
        "pair_spread": ordered[2] - ordered[0],
    }


def aperture(left_x, left_y, right_x, right_y, up_x, up_y, low_x, low_y) -> Column:
    """Lip-pair distance across the corner axis, relative to the axis length.

    Unchanged by shifting, scaling or rolling the landmarks. NULL for a
    vanishing axis.
    """
    axis_x, axis_y = col(right_x) - col(left_x), col(right_y) - col(left_y)
    length2 = axis_x * axis_x + axis_y * axis_y
    cross = axis_x * (col(low_y) - col(up_y)) - axis_y * (col(low_x) - col(up_x))
    return F.when(length2 > 1e-18, F.abs(cross) / length2)


def to_frame_pixels(x, y, crop_left, crop_top, crop_width, crop_height) -> tuple[Column, Column]:
    """Crop-relative landmark (0..1) to frame pixels."""
    return col(crop_left) + col(x) * col(crop_width), col(crop_top) + col(y) * col(crop_height)


def detection_quality(
    face_width, mouth_width, in_frame, lips_in_frame, texture, minimum_face_px: float = 96.0, minimum_mouth_px: float = 20.0
) -> Column:
    """Size x pose x visibility x texture, clipped to 0..1.

    0 when the face or the mouth is too small or fewer than 98 % of the lip
    points lie in the frame. An unknown texture counts 0.65.
    """
    face, mouth = col(face_width), col(mouth_width)
    size = F.least(
        F.lit(1.0), face / F.lit(minimum_face_px * 1.5), mouth / F.lit(minimum_mouth_px * 1.5)
    )
    pose = clip((mouth / face - F.lit(0.10)) / F.lit(0.13), 0.0, 1.0)
    surface = F.lit(0.65) + F.lit(0.35) * F.coalesce(clip(col(texture) / F.lit(5.0), 0.0, 1.0), F.lit(0.0))
    usable = (face >= minimum_face_px) & (mouth >= minimum_mouth_px) & (col(lips_in_frame) >= 0.98)
    return F.when(usable, clip(size * pose * col(in_frame) * surface, 0.0, 1.0)).otherwise(F.lit(0.0))
