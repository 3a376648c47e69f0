"""Event lags to epochs, strata, rates and descriptives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagledger.functions.numeric import direction, finite
from lagledger.operators.quantiles import HOT_ROWS, median_and_mad, quantiles

FRAME_MS = 1000.0 / 24.0
MARGIN_MS = 2.0 * FRAME_MS
EPOCH = ("speaker", "grp", "epoch_id")


def epoch_summary(
    events: DataFrame,
    *,
    margin_ms: float = MARGIN_MS,
    keys: Sequence[str] = EPOCH,
    lag: str = "lag_ms",
    max_rows: int | None = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Count, median, unscaled MAD and share above the margin per epoch.

    Rows with measurable = false or a lag that is not finite stay in the
    ledger but do not enter here.
    """
    used = events.withColumn(lag, finite(lag)).filter(F.col(lag).isNotNull())
    if "measurable" in events.columns:
        used = used.filter(F.coalesce("measurable", F.lit(True)))
    return median_and_mad(
        used, keys, lag, median="median_lag_ms", mad="mad_lag_ms", max_rows=max_rows, probe=probe,
        extra=[
            F.count(F.lit(1)).alias("event_count"),
            F.avg((F.col(lag) > margin_ms).cast("double")).alias("fraction_over_margin"),
        ],
    )


def in_strata(df: DataFrame, label: str, strata: Mapping[str, Sequence[str]], name: str = "stratum") -> DataFrame:
    """One copy of a row per stratum its label belongs to (strata may overlap)."""
    hits = F.array_compact(
        F.array(*[F.when(F.col(label).isin(*labels), F.lit(s)) for s, labels in strata.items()])
    )
    return df.withColumn(name, F.explode(hits))


def disposition_counts(ledger: DataFrame, group: str, speaker: str, flags: Mapping[str, Column]) -> DataFrame:
    """Counts of each flag overall, per group and per speaker in one pass."""
    base = ledger.select(
        F.coalesce(F.col(group).cast("string"), F.lit("unassigned")).alias("_g"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unassigned")).alias("_s"),
        *[F.coalesce(cond, F.lit(False)).cast("long").alias(n) for n, cond in flags.items()],
    )
    counted = base.groupingSets([[], [F.col("_g")], [F.col("_s")]], F.col("_g"), F.col("_s")).agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("selected"), *[F.sum(n).alias(n) for n in flags]
    )
    # Bit 2 is the group column, bit 1 the speaker column; a set bit means "rolled up".
    return counted.select(
        F.when(F.col("_level") == 3, "overall").when(F.col("_level") == 1, "group").otherwise("speaker").alias("scope"),
        F.coalesce("_g", "_s", F.lit("all")).alias("name"), "selected", *flags,
    )


def reason_counts(ledger: DataFrame, reasons: str = "exclusion_reasons") -> DataFrame:
    return ledger.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("events")
    )


RATE_METRICS = (
    "no_visible_contact_rate", "not_strong_contact_rate", "post_audio_only_contact_rate", "video_leads_rate",
    "video_lags_rate", "far_direction_rate", "direction_unavailable_rate", "median_edge_lag_ms",
)


def direction_rates(
    events: DataFrame, keys: Sequence[str], *, margin_ms: float, everyone: DataFrame | None = None
) -> DataFrame:
    """Closure and direction counts and rates per key over face-valid events.

    Needs ``closure``, ``edge_lag_ms``, ``face_valid``, ``post_audio_only`` and
    ``edge_count``. A zero denominator gives NULL; keys of ``everyone`` without
    events stay with zero counts. For epochs, pass face-valid events only.
    """
    way = direction("edge_lag_ms", margin_ms)
    valid = F.coalesce(F.col("face_valid"), F.lit(False))
    hits = lambda cond: F.count_if(valid & F.coalesce(cond, F.lit(False)))
    share = lambda cond: F.try_divide(hits(cond), F.count_if(valid))
    closure = F.col("closure")
    table = quantiles(
        events.withColumn("_lag", F.when(valid, F.col("edge_lag_ms"))), keys, "_lag", {"median_edge_lag_ms": 0.5},
        extra=[
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(valid).alias("face_valid_count"),
            hits(closure == "no_visible_contact").alias("no_visible_contact_count"),
            hits(closure == "weak_contact").alias("weak_contact_count"),
            hits(closure == "strong_contact").alias("strong_contact_count"),
            hits(F.col("edge_count") > 1).alias("multiple_edge_count"),
            share(closure == "no_visible_contact").alias("no_visible_contact_rate"),
            share(closure.isin("no_visible_contact", "weak_contact")).alias("not_strong_contact_rate"),
            share(F.col("post_audio_only")).alias("post_audio_only_contact_rate"),
            share(way == "video_leads").alias("video_leads_rate"),
            share(way == "video_lags").alias("video_lags_rate"),
            share(way.isin("video_leads", "video_lags")).alias("far_direction_rate"),
            share(way == "unavailable").alias("direction_unavailable_rate"),
        ],
    )
    if everyone is None:
        return table
    counts = [c for c in table.columns if c.endswith("_count")]
    return everyone.select(*keys).distinct().join(table, list(keys), "left").fillna(0, subset=counts)


def shape_rates(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mouth-shape counts, open rate and median aperture at the audio time.

    Needs measurable audio and a valid shape; a visual time is not needed.
    """
    used = events.filter(F.col("audio_measurable") & F.col("shape_valid"))
    return quantiles(
        used, keys, "aperture", {"median_aperture": 0.5},
        extra=[
            F.count(F.lit(1)).alias("shape_count"),
            F.count_if(F.col("shape") == "closed/contact").alias("closed_count"),
            F.count_if(F.col("shape") == "transition").alias("transition_count"),
            F.count_if(F.col("shape") == "open").alias("open_count"),
            F.avg((F.col("shape") == "open").cast("double")).alias("open_rate"),
        ],
    )


def absolute_lag_descriptives(events: DataFrame, lag: str = "lag_ms") -> tuple[DataFrame, DataFrame]:
    """(per group: median over epochs of the epoch median |lag|, counts and the groups' difference; per speaker: signed and absolute median/MAD)."""
    used = events.filter(F.col(lag).isNotNull()).withColumn("abs_lag_ms", F.abs(F.col(lag)))
    epochs = quantiles(used, EPOCH, "abs_lag_ms", {"epoch_abs_ms": 0.5})
    groups = quantiles(
        epochs, ["grp"], "epoch_abs_ms", {"median_epoch_abs_ms": 0.5}, extra=[F.count(F.lit(1)).alias("epochs")]
    ).join(used.groupBy("grp").agg(F.count(F.lit(1)).alias("events")), "grp")
    # Two rows at most carry the difference, so a scalar subquery holds it.
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col("median_epoch_abs_ms")))
    difference = groups.agg((side("candidate") - side("control")).alias("d"))
    groups = groups.withColumn("candidate_minus_control_ms", difference.scalar())
    signed = median_and_mad(used, ["speaker"], lag, median="median_ms", mad="mad_ms")
    absolute = median_and_mad(used, ["speaker"], "abs_lag_ms", median="median_abs_ms", mad="mad_abs_ms")
    return groups, signed.join(absolute, "speaker")
