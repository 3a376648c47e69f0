"""Review annotations: normalising, guards and eligibility. Rows stay, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagledger.functions.numeric import finite
from lagledger.operators.rules import passes, reasons

# Accepted answers.
STATUSES = ("measurable", "unmeasurable")
CONFIDENCES = ("high", "medium", "low")
REALIZATIONS = ("p", "b", "other", "uncertain")
TARGETS = ("p", "b")


def covered(t: Column, spans: Column) -> Column:
    """t inside one of the half-open spans after rounding to 9 decimals."""
    r = lambda c: F.round(c, 9)
    return F.exists(spans, lambda s: (r(s["start_s"]) <= r(t)) & (r(t) < r(s["end_s"])))


def spans_in_order(spans: Column, start: Column, end: Column) -> Column:
    """Spans are non-empty, sorted, disjoint and inside [start, end]."""
    each = F.forall(spans, lambda s: (s["start_s"] < s["end_s"]) & (s["start_s"] >= start) & (s["end_s"] <= end))
    n = F.size(spans)
    steps = F.zip_with(
        F.slice(spans, 1, F.greatest(n - 1, F.lit(0))), F.slice(spans, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: a["end_s"] <= b["start_s"],
    )
    return each & F.forall(steps, lambda ok: ok)


def annotation_guard(rows: DataFrame, target: str) -> DataFrame:
    """Label, time and coverage rules on an annotation.

    Needs ``label`` and ``nested_label`` (NULL if absent), ``time_s``,
    ``window_start_s``, ``window_end_s`` and ``covered_intervals``.
    """
    t = finite("time_s")
    spans, a, b = F.col("covered_intervals"), F.col("window_start_s"), F.col("window_end_s")
    off = lambda c: F.coalesce(F.col(c) != target, F.lit(False))
    unlabelled = F.col("label").isNull() & F.col("nested_label").isNull()
    ordered = spans_in_order(spans, a, b)
    return rows.withColumn(
        "guard_reasons",
        reasons(
            (off("label") | off("nested_label"), "explicit_non_target_label"),
            (t.isNull() | (t < 0), "time_not_finite"),
            (~((t >= a) & (t < b)), "time_outside_review_window"),
            (~ordered, "invalid_covered_intervals"),
            (ordered & ~covered(t, spans), "time_not_covered"),
        ),
    ).withColumns(
        {"label_state": F.when(unlabelled, "legacy_unspecified").otherwise("explicit"), "guard_clean": passes("guard_reasons")}
    )


def status_consistency(rows: DataFrame) -> DataFrame:
    """Status, time, class and group agree. Needs status, time_s, phoneme_class, selected_class, speaker, grp, epoch_id."""
    t = finite("time_s")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    measurable = F.col("status") == "measurable"
    return rows.withColumn(
        "status_reasons",
        reasons(
            (blank("status"), "status_missing"),
            (measurable & (t.isNull() | (t < 0)), "measurable_without_time"),
            (~measurable & F.col("time_s").isNotNull(), "unmeasurable_with_time"),
            (~F.col("phoneme_class").eqNullSafe(F.col("selected_class")), "class_mismatch"),
            (blank("speaker") | blank("epoch_id"), "metadata_missing"),
            (~F.coalesce(F.col("grp").isin("candidate", "control"), F.lit(False)), "unknown_group"),
        ),
    )


def audio_scope(rows: DataFrame, cutoff: float) -> DataFrame:
    """In scope: measurable, guard clean, token and audio time before the cutoff."""
    inside = (
        (F.col("status") == "measurable") & F.col("guard_clean") & (F.col("token_s") < cutoff) & (finite("time_s") < cutoff)
    )
    return rows.withColumn("audio_in_scope", F.coalesce(inside, F.lit(False)))


def normalize_annotation(rows: DataFrame) -> DataFrame:
    """Two accepted layouts to one: nested selection fields or flat fields; flat overrides nested.

    Columns: ``selection`` (struct with phoneme_class), ``annotation_status``,
    ``audio_release_time_s`` and flat ``status``, ``selected_release_time_s``,
    ``phoneme_class`` (NULL where a layout is not used).
    """
    cls = F.coalesce("phoneme_class", "selection.phoneme_class")
    return rows.withColumns(
        {
            "norm_status": F.coalesce("status", "annotation_status"),
            "norm_time_s": F.coalesce("selected_release_time_s", "audio_release_time_s"),
            "norm_class": cls,
            "norm_reasons": reasons(
                (F.col("selection.phoneme_class").isNotNull() & (cls != F.col("selection.phoneme_class")), "class_differs_from_selection"),
            ),
        }
    )


def review_row_valid(rows: DataFrame, tolerance_ms: float = 20.0, anchor_tolerance: float = 1e-6, relative_tolerance_ms: float = 0.001) -> DataFrame:
    """A filled review sheet row: answers, key, review window, candidates and the chosen time, each rule a reason.

    Needs status, confidence, realization, reason, selected_rank, relative_ms, ``candidates`` (array of rank, time_s,
    relative_ms; rank and relative_ms may be NULL), anchor_s, source_anchor_s, target_class, window bounds and
    covered_intervals. A rank is a place in the list and wins over the relative time. Answers are compared trimmed and
    in lower case.
    """
    plain = lambda c: F.lower(F.trim(c))
    known = lambda c, allowed: F.coalesce(plain(c).isin(*allowed), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    a, b, anchor, rank, relative = (F.col(c) for c in ("window_start_s", "window_end_s", "anchor_s", "selected_rank", "relative_ms"))
    spans, listed = F.col("covered_intervals"), F.col("candidates")
    measurable = yes(plain("status") == "measurable")
    in_range = yes((rank >= 1) & (rank <= F.size(listed)))
    pick = F.when(in_range, F.get(listed, rank - 1))
    chosen = F.when(rank.isNotNull(), pick["time_s"]).otherwise(anchor + relative / 1000.0)
    out = rows.withColumn("chosen_time_s", F.when(measurable, chosen))
    time = F.col("chosen_time_s")
    usable = yes(finite("window_start_s").isNotNull() & finite("window_end_s").isNotNull() & (a >= 0) & (a <= anchor) & (anchor < b))
    inside = lambda t: yes(finite(t).isNotNull() & (t >= a) & (t < b))
    places = F.transform(listed, lambda c, i: F.struct(c.alias("c"), (i + 1).alias("place")))
    shift = lambda c: (c["time_s"] - anchor) * 1000.0
    return out.withColumn(
        "review_reasons",
        reasons(
            (~known("status", STATUSES), "invalid_status"),
            (~known("confidence", CONFIDENCES), "invalid_confidence"),
            (~known("realization", REALIZATIONS), "invalid_realization"),
            (F.coalesce(F.trim("reason"), F.lit("")) == "", "reason_missing"),
            (~yes(finite("anchor_s").isNotNull() & (anchor >= 0) & (F.abs(anchor - F.col("source_anchor_s")) <= anchor_tolerance)), "anchor_differs_from_source"),
            (~usable, "invalid_review_window"),
            (~yes(spans_in_order(spans, a, b)), "invalid_covered_intervals"),
            (F.exists(places, lambda p: yes(p["c"]["rank"] != p["place"])), "candidate_rank_not_its_place"),
            (F.exists(listed, lambda c: ~inside(c["time_s"])), "candidate_outside_review_window"),
            (F.exists(listed, lambda c: inside(c["time_s"]) & ~yes(covered(c["time_s"], spans))), "candidate_not_covered"),
            (F.exists(listed, lambda c: c["relative_ms"].isNotNull() & ~yes(F.abs(c["relative_ms"] - shift(c)) <= relative_tolerance_ms)), "candidate_relative_time_differs"),
            (measurable & ~yes((plain("realization") == F.lower(F.btrim("target_class", F.lit("/ ")))) & plain("realization").isin(*TARGETS)), "measurable_requires_target"),
            (measurable & rank.isNull() & relative.isNull(), "no_time_chosen"),
            (measurable & rank.isNotNull() & ~in_range, "rank_out_of_range"),
            (measurable & yes(F.abs(pick["time_s"] - (anchor + relative / 1000.0)) > tolerance_ms / 1000.0), "rank_and_time_disagree"),
            (measurable & time.isNotNull() & ~inside(time), "time_outside_review_window"),
            (measurable & inside(time) & ~yes(covered(time, spans)), "time_not_covered"),
            (yes(plain("status") == "unmeasurable") & (rank.isNotNull() | relative.isNotNull()), "unmeasurable_with_time"),
        ),
    )


def profile_gate(sources: DataFrame, profile: dict[str, object], fps: float, tolerance: float = 0.01) -> DataFrame:
    """Every media field that differs from the supported profile is listed."""
    rules = [(~F.col(n).eqNullSafe(F.lit(v)), f"{n}_differs") for n, v in profile.items()]
    rules.append((~F.coalesce(F.abs(F.col("average_fps") - fps) <= tolerance, F.lit(False)), "average_fps_differs"))
    return sources.withColumn("profile_reasons", reasons(*rules))


def auto_accept(rows: DataFrame, minimum_probability: float = 0.80) -> DataFrame:
    """Accepted when the audio is measurable and the word is likely; measurable only with the visual side too."""
    accepted = F.coalesce(F.col("audio_measurable") & (F.col("asr_probability") >= minimum_probability), F.lit(False))
    return rows.withColumn("auto_accepted", accepted).withColumn(
        "final_measurable", accepted & F.coalesce("visual_measurable", F.lit(False))
    )


def shape_valid(rows: DataFrame, limits, period: str, error: str) -> DataFrame:
    """Mouth shape at the audio time from its nearest frame, or why it is unavailable."""
    from lagledger.operators.sequence import mouth_state

    missing = F.lit(False)
    for c in ("median_aperture", "maximum_aperture", "aperture_spread", "mouth_width_px", "face_quality"):
        missing = missing | finite(c).isNull()
    listed = reasons(
        (~F.coalesce("face_detected", F.lit(False)), "face_not_detected_at_acoustic_release"),
        (missing, "nonfinite_mouth_geometry_at_acoustic_release"),
        (F.col("mouth_width_px") < limits.width_px, "mouth_resolution_too_low_at_acoustic_release"),
        (F.col("aperture_spread") > limits.spread, "inconsistent_lip_landmarks_at_acoustic_release"),
        (F.col("face_quality") < limits.quality, "low_face_quality_at_acoustic_release"),
        (F.col(error).isNull() | (F.abs(error) > F.greatest(F.lit(0.050), 0.75 * F.col(period))), "no_video_frame_near_acoustic_release"),
    )
    out = rows.withColumn("shape_reasons", listed).withColumn("shape_valid", passes("shape_reasons"))
    state = mouth_state("median_aperture", "maximum_aperture", limits)
    return out.withColumn("shape", F.when(F.col("shape_valid"), state).otherwise("unavailable"))


def direction_counts(rows: DataFrame, keys: list[str], lag: str, shape: str, frame_ms: float, valid: str) -> DataFrame:
    """Twelve counters per key, zeros included; a key without an eligible event has zeros only.

    Eligible are rows with a valid mouth shape. Within one frame either sign is consistent; a later video needs a mouth not
    yet open, an earlier one an open mouth. A lag that is NULL or not finite is counted apart.
    """
    ok, l = F.coalesce(F.col(valid), F.lit(False)), finite(lag)
    known, within = ok & l.isNotNull(), F.abs(l) <= frame_ms
    later, earlier = known & ~within & (l > 0), known & ~within & (l < 0)
    shut, opened = F.col(shape).isin("closed/contact", "transition"), F.col(shape) == "open"
    fits = lambda side, good: side & F.coalesce(good, F.lit(False))
    odd = lambda side, good: side & ~F.coalesce(good, F.lit(False))
    counters = {
        "burst_shape_eligible_event_count": ok, "lag_available_count": known, "lag_unavailable_count": ok & l.isNull(),
        "within_one_frame_count": known & within, "positive_beyond_one_frame_count": later,
        "positive_consistent_count": fits(later, shut), "positive_inconsistent_count": odd(later, shut),
        "negative_beyond_one_frame_count": earlier, "negative_consistent_count": fits(earlier, opened), "negative_inconsistent_count": odd(earlier, opened),
        "consistent_count": (known & within) | fits(later, shut) | fits(earlier, opened),
        "inconsistent_count": odd(later, shut) | odd(earlier, opened),
    }
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def direction_consistency(lag: str, shape: str, frame_ms: float) -> Column:
    """Does the mouth shape at the audio time fit the sign of the lag?"""
    l, s = F.col(lag), F.col(shape)
    return (
        F.when(l.isNull(), "lag_unavailable").when(s.isNull() | (s == "unavailable"), "shape_unavailable")
        .when(F.abs(l) <= frame_ms, "consistent_within_one_frame")
        .when((l > 0) & s.isin("closed/contact", "transition"), "consistent_video_lags")
        .when((l < 0) & (s == "open"), "consistent_video_leads")
        .when(l > 0, "inconsistent_video_lags").otherwise("inconsistent_video_leads")
    )
