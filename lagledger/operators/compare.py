"""Clip metrics to groups, and one designated clip against each group, metric by metric.

There is no score across metrics and no ranking of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagledger.functions import text as tx
from lagledger.functions.numeric import designated_relations, finite
from lagledger.operators.quantiles import quantiles
from lagledger.operators.rules import reasons
from lagledger.session import broadcast_if_small

# Registered clip metrics and their units.
METRICS = {
    "duration_s": "s",
    "active_frame_fraction": "ratio",
    "voiced_fraction_of_active": "ratio",
    "f0_median_hz": "Hz",
    "f0_iqr_hz": "Hz",
    "periodicity_median": "normalized peak",
    "rms_dbfs": "dBFS",
    "spectral_centroid_median_hz": "Hz",
    "spectral_flatness_median": "ratio",
    "stereo_balance_median_db": "dB",
    "stereo_correlation_median": "correlation",
    "stereo_side_fraction_median": "ratio",
    "mean_active_band_fraction_low_0_500": "power fraction",
    "mean_active_band_fraction_mid_500_2000": "power fraction",
    "mean_active_band_fraction_high_2000_8000": "power fraction",
    "mean_active_band_fraction_upper_8000_nyquist": "power fraction",
}


def long_metrics(clips: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric_id, value); non-finite values become NULL."""
    return clips.select(*keys, *[finite(m).alias(m) for m in metrics]).unpivot(
        list(keys), list(metrics), "metric_id", "value"
    )


def group_metrics(clips: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Count of values, minimum, maximum and median per group and metric, unweighted over clips."""
    return quantiles(
        long_metrics(clips, [group], metrics), [group, "metric_id"], "value", {"median": 0.5},
        extra=[F.count("value").alias("value_count"), F.min("value").alias("min"), F.max("value").alias("max")],
    )


def designated_comparison(groups: DataFrame, designated: DataFrame, group: str) -> DataFrame:
    """One row per (metric, comparison group): the designated value beside the group's range.

    ``designated`` has one row per metric (16 registered metrics); it is
    broadcast once its size has been seen.
    """
    d = designated.select("metric_id", F.col("value").alias("designated_value"))
    joined = groups.join(broadcast_if_small(d), "metric_id")
    return joined.withColumns(designated_relations("min", "max", "median", "designated_value"))


def registry_mismatches(groups: DataFrame, group: str, registry: DataFrame) -> DataFrame:
    """Metrics a group lacks, and metrics outside the registry (16 rows)."""
    names = groups.select(group).distinct()
    listed = registry.agg(F.collect_set("metric_id").alias("_m"))
    wanted = names.withColumn("_m", listed.scalar()).select(group, F.explode("_m").alias("metric_id"))
    from lagledger.operators.ledger import key_differences

    diff = key_differences(wanted, groups.select(group, "metric_id"), [group, "metric_id"])
    return diff.select(
        group, "metric_id", F.when(F.col("side") == "left_only", "metric_missing").otherwise("metric_not_registered").alias("problem")
    )


def group_stats_reasons(groups: DataFrame, clip_count: str) -> DataFrame:
    """Rules on min/median/max/value_count per group row; the row stays with its reasons."""
    n = F.col("value_count")
    stats = [F.col(c) for c in ("min", "median", "max")]
    nulls = sum((c.isNull().cast("int") for c in stats), F.lit(0))
    lo, mid, hi = stats
    return groups.withColumn(
        "stats_reasons",
        reasons(
            ((n < 0) | (n != F.floor(n)), "invalid_value_count"),
            (n > F.col(clip_count), "more_values_than_clips"),
            (((n == 0) & (nulls != 3)) | ((n > 0) & (nulls != 0)), "nulls_do_not_match_count"),
            (~((lo <= mid) & (mid <= hi)), "statistics_out_of_order"),
            ((F.col(clip_count) == 1) & ~((lo == mid) & (mid == hi)), "single_clip_statistics_differ"),
        ),
    )


def group_consistency(clips: DataFrame, *labels: str, group: str = "group_id") -> DataFrame:
    """One label (and colour) per group, valid ids, finite non-empty intervals; reasons per clip."""
    per_group = clips.groupBy(group).agg(
        *[(F.min(l) != F.max(l)).alias(f"_many_{l}") for l in labels]
    )
    s, e = finite("start_s"), finite("end_s")
    return clips.join(per_group, group).withColumn(
        "consistency_reasons",
        reasons(
            *[(F.col(f"_many_{l}"), f"group_has_several_{l}s") for l in labels],
            (~tx.valid_id("clip_id"), "invalid_clip_id"),
            (s.isNull() | e.isNull(), "interval_not_finite"),
            (s < 0, "negative_start"),
            (e <= s, "empty_interval"),
        ),
    ).drop(*[f"_many_{l}" for l in labels])
