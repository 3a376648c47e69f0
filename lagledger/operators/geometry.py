"""Closure evidence inside one audio event's window of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagledger.operators.rules import passes, reasons


def closure_geometry(
    window: DataFrame, event: str, time: str, *, minimum_usable: float = 0.60, nearest_within: float = 0.050,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """Closure class per event from its window frames.

    ``window`` rows: event, ``audio_time``, frame time (NULL for an event
    without frames), ``usable``, ``state``. Partial evidence can show contact,
    but absence needs every frame of the window to be usable. ``coverage``
    may add the reasons of :func:`native_coverage`.
    """
    t, audio = F.col(time), F.col("audio_time")
    usable = F.coalesce(F.col("usable"), F.lit(False))
    contact = usable & (F.col("state") == "closed/contact")
    table = window.groupBy(event, "audio_time").agg(
        F.count(t).alias("frame_count"),
        F.count_if(usable).alias("usable_count"),
        F.count_if(contact).alias("contact_count"),
        F.min(F.when(usable, F.abs(t - audio))).alias("nearest_error"),
        F.min(F.when(contact, t - audio)).alias("earliest_contact"),
    ).withColumn("usable_fraction", F.coalesce(F.try_divide(F.col("usable_count"), F.col("frame_count")), F.lit(0.0)))
    found = reasons(
        (F.col("frame_count") == 0, "no_native_pts_frames_in_closure_window"),
        (F.col("usable_fraction") < minimum_usable, "insufficient_valid_nonrepeated_face_fraction"),
        (
            F.col("nearest_error").isNull() | (F.col("nearest_error") > nearest_within),
            "no_valid_nonrepeated_frame_near_audio_release",
        ),
        (
            (F.col("contact_count") == 0) & (F.col("usable_count") < F.col("frame_count")),
            "incomplete_usable_frame_coverage_for_absence",
        ),
    )
    if coverage is not None:
        table = table.join(coverage.select(event, "coverage_reasons"), event, "left")
        found = F.array_distinct(F.concat(F.coalesce("coverage_reasons", F.array().cast("array<string>")), found))
    return (
        table.withColumn("face_reasons", found)
        .withColumn("face_valid", passes("face_reasons"))
        .withColumn("closure", closure_category("face_valid", "contact_count"))
    )


def closure_category(face_valid: str, contacts: str) -> Column:
    n = F.col(contacts)
    return (
        F.when(~F.col(face_valid), "unavailable").when(n == 0, "no_visible_contact")
        .when(n == 1, "weak_contact").otherwise("strong_contact")
    )


def post_audio_only(earliest_contact: str, frame: float) -> Column:
    """Valid face and the earliest contact later than one frame after the audio event."""
    return F.col("face_valid") & F.coalesce(F.col(earliest_contact) > frame, F.lit(False))
