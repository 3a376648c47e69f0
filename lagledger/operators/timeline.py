"""Assembled timelines, frame maps and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagledger.operators.rules import reasons
from lagledger.operators.scan import Slicing, dealt, scan


def assemble_timeline(
    clips: DataFrame, keys: Sequence[str], order: str, length: str, slicing: Slicing, *,
    intro: int, gap: int, outro: int, frame: int,
) -> DataFrame:
    """Intro, clips with gaps between them, outro and padding to a whole frame.

    Lengths are samples. Rows: (key, position, phase, clip order or NULL,
    start_sample, end_sample).
    """
    n = F.col(length).cast("long")
    laid = scan(
        clips, keys, order, slicing, running={"_upto": n + F.lit(gap)}, index="_i"
    ).withColumn("_end", F.lit(intro) + F.col("_upto") - F.lit(gap))
    clip_part = F.struct(
        F.lit("clip").alias("phase"), F.col(order).cast("long").alias("clip"), (F.lit(1) + 2 * F.col("_i")).alias("position"),
        (F.col("_end") - n).alias("start_sample"), F.col("_end").alias("end_sample"),
    )
    gap_part = F.struct(
        F.lit("gap").alias("phase"), F.lit(None).cast("long").alias("clip"), (2 * F.col("_i")).alias("position"),
        (F.col("_end") - n - F.lit(gap)).alias("start_sample"), (F.col("_end") - n).alias("end_sample"),
    )
    parts = F.array_compact(F.array(F.when((F.col("_i") > 0) & F.lit(gap > 0), gap_part), clip_part))
    body = laid.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    total = laid.groupBy(*keys).agg(F.max("_end").alias("_last"), F.max("_i").alias("_i"))
    stop = F.col("_last") + F.lit(outro)
    padded = F.ceil(stop / F.lit(frame)) * F.lit(frame)
    part = lambda phase, at, a, b: F.struct(
        F.lit(phase).alias("phase"), F.lit(None).cast("long").alias("clip"), at.cast("long").alias("position"),
        a.cast("long").alias("start_sample"), b.cast("long").alias("end_sample"),
    )
    at = 2 * F.col("_i")
    edges = total.select(
        *keys,
        F.explode(
            F.array(
                part("intro", F.lit(0), F.lit(0), F.lit(intro)),
                part("outro", at + 2, F.col("_last"), stop),
                part("pad", at + 3, stop, padded),
            )
        ).alias("p"),
    ).select(*keys, "p.*")
    return body.unionByName(edges).filter(F.col("end_sample") > F.col("start_sample"))


def frame_map_violations(
    frames: DataFrame, keys: Sequence[str], index: str, pts: str, fps: float, slicing: Slicing, *, hold: int, ties: Sequence[str] = ()
) -> DataFrame:
    """Rows of an output frame map that break a rule, with the rules.

    Index runs from 0 without holes; pts = index / fps; in a normal section
    the source moves by one per frame, in a slow one it stays or moves by one,
    and in a gap it stays.
    """
    source = F.struct(index, "phase", "event_id", "source_index")
    seen = scan(frames, keys, index, slicing, ties=ties, before={"_p": source})
    same = F.col("_p.phase").eqNullSafe(F.col("phase")) & F.col("_p.event_id").eqNullSafe(F.col("event_id"))
    step = F.col("source_index") - F.col("_p.source_index")
    first = F.col("_p").isNull()
    rules = reasons(
        (F.when(first, F.col(index) != 0).otherwise(F.col(index) != F.col(f"_p.{index}") + 1), "index_not_contiguous"),
        (F.abs(F.col(pts) - F.col(index) / F.lit(fps)) > 1e-6, "pts_differs_from_index"),
        (~first & same & (F.col("phase") == "normal") & (step != 1), "normal_source_not_consecutive"),
        (~first & same & (F.col("phase") == "slow") & ~step.isin(0, 1), "slow_source_jumps"),
        (~first & (F.col("phase") == "gap") & (step != 0), "gap_source_changed"),
    )
    rows = seen.withColumn("violations", rules).filter(F.size("violations") > 0).select(
        *keys, F.col(index).alias("at"), F.explode("violations").alias("violation")
    )
    held = (
        frames.filter(F.col("phase") == "slow").groupBy(*keys, "event_id", "source_index")
        .agg(F.count(F.lit(1)).alias("_held"), F.min(index).alias("at"))
        .filter(F.col("_held") != hold)
    )
    return rows.unionByName(held.select(*keys, "at", F.lit("wrong_hold_count").alias("violation")))


def section_violations(
    frames: DataFrame, sections: DataFrame, keys: Sequence[str], index: str, order: str, ties: Sequence[str], count: str, slicing: Slicing, frame_slicing: Slicing
) -> DataFrame:
    """(key, position, violation, frames) of a frame map against the sections its manifest declares.

    Sections (key, phase, event_id, declared count) follow one another in ``order`` from frame 0. A frame must carry phase and
    event of the section its index falls into (``row_differs``), every section must find as many frames as declared
    (``section_truncated`` counts those that lack), and no frame may lie behind the last section (``outside_sections``, position NULL).
    The tasks of ``frame_slicing`` hold for the counts per section as well.
    """
    from lagledger.operators.nearest import point_in_interval

    n = F.col(count).cast("long")
    laid = scan(sections, keys, order, slicing, ties=ties, running={"_stop": n}, index="position")
    spans = laid.select(*keys, "position", F.col("phase").alias("_phase"), F.col("event_id").alias("_event"), (F.col("_stop") - n).alias("_start"), "_stop")
    placed = point_in_interval(
        frames.select(*keys, index, "phase", "event_id"), spans.filter("_stop > _start"), keys, index, "_start", "_stop", frame_slicing, tie="position", out="_in"
    )
    position = F.col("_in.position")
    fits = F.col("phase").eqNullSafe(F.col("_in._phase")) & F.col("event_id").eqNullSafe(F.col("_in._event"))
    # One row per section on both sides, counted in one grouping; NULL keys count as a key.
    none = F.lit(0).cast("long")
    seen = placed.select(*keys, position.alias("position"), F.lit(1).cast("long").alias("_have"), (~fits).cast("long").alias("_other"), none.alias("_want"))
    declared = spans.select(*keys, "position", none.alias("_have"), none.alias("_other"), (F.col("_stop") - F.col("_start")).alias("_want"))
    both = dealt(seen.unionByName(declared), [*keys, "position"], frame_slicing.tasks).groupBy(*keys, "position").agg(
        *[F.sum(c).alias(c) for c in ("_have", "_other", "_want")]
    )
    outside = F.col("position").isNull()
    found = lambda name, frames: F.struct(F.lit(name).alias("violation"), frames.alias("frames"))
    rules = F.array(
        found("outside_sections", F.when(outside, F.col("_have"))), found("row_differs", F.when(~outside, F.col("_other"))),
        found("section_truncated", F.when(~outside, F.col("_want") - F.col("_have"))),
    )
    return both.select(*keys, "position", F.explode(rules).alias("r")).select(*keys, "position", "r.*").filter("frames > 0")


def marker_mapped(frames: DataFrame, markers: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    """(key, at, source_pts, violation or NULL) of each marker: the frame nearest to it on the output must show the release.

    ``frames`` holds (key, index, output_pts, source_pts), ``markers`` one row per key with marker_output_s and release_s. Of
    frames equally near the first counts, of repeated ones that of the smaller source time; a marker without frames is ``marker_missing``, one whose frame lies more than a frame
    and 1 ms from the release is ``marker_shifted``.
    """
    near = (
        frames.join(markers.select(*keys, "marker_output_s"), list(keys))
        .groupBy(*keys).agg(F.min_by(F.struct("index", "source_pts"), F.struct(F.abs(F.col("output_pts") - F.col("marker_output_s")), "index", "source_pts")).alias("_at"))
    )
    out = markers.join(near, list(keys), "left")
    wrong = F.when(F.col("_at").isNull(), "marker_missing").when(F.abs(F.col("_at.source_pts") - F.col("release_s")) > 1.0 / fps + 0.001, "marker_shifted")
    return out.select(*keys, F.col("_at.index").alias("at"), F.col("_at.source_pts").alias("source_pts"), wrong.alias("violation"))


def marker_violations(frames: DataFrame, events: DataFrame, event: str, fps: float) -> DataFrame:
    """Events whose marked frame is more than one frame from the release, or absent."""
    marked = frames.filter("marker").groupBy(event).agg(F.min("source_pts").alias("_at"))
    out = events.join(marked, event, "left")
    return out.select(
        event,
        F.explode(
            reasons(
                (F.col("_at").isNull(), "marker_missing"),
                (F.abs(F.col("_at") - F.col("release_s")) > 1.0 / fps + 1e-9, "marker_shifted"),
            )
        ).alias("violation"),
    )


def reuse_join(slow: DataFrame, normal: DataFrame, hold: int, signature: str) -> DataFrame:
    """Each slow source among the normal frames, repeated exactly ``hold`` times, with signature difference."""
    from lagledger.functions.vectors import mean_abs_difference

    by = ["event_id", "source_index"]
    right = normal.select(*by, F.col(signature).alias("_ref"))
    joined = slow.join(right, by, "left").withColumn("_d", mean_abs_difference(signature, "_ref"))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.col("_ref").isNotNull().cast("int")).alias("_in"),
        F.avg("_d").alias("mean_difference"), F.max("_d").alias("max_difference"),
    ).select(
        *by, "copies", (F.col("copies") == hold).alias("hold_ok"), (F.col("_in") == 1).alias("in_normal"),
        "mean_difference", "max_difference",
    )


def phase_lookup(
    samples: DataFrame, timeline: DataFrame, keys: Sequence[str], at: str, slicing: Slicing
) -> DataFrame:
    """Timeline phase of each sample position; ``phase_ok`` is false outside every phase."""
    from lagledger.operators.nearest import point_in_interval

    spans = timeline.select(*keys, "position", "phase", "clip", "start_sample", "end_sample")
    out = point_in_interval(samples, spans, keys, at, "start_sample", "end_sample", slicing, tie="position", out="span")
    return out.withColumns(
        {
            "phase": F.col("span.phase"), "clip": F.col("span.clip"), "phase_ok": F.col("span").isNotNull(),
            "source_offset": F.when(F.col("span.phase") == "clip", F.col(at) - F.col("span.start_sample")),
        }
    ).drop("span", "placement")
