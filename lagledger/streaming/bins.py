"""Tumbling-bin sums over an unbounded sample stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lagledger.operators.signal import weighted_frame


def stream_bins(samples: DataFrame, key: str, ts: str, value: str, *, width: str, delay: str) -> DataFrame:
    """Energy, count and peak per (key, bin); partial sums, so samples are never stored.

    A bin is emitted once the watermark passes its end. Rows later than
    ``delay`` are dropped by the stream; the batch function keeps every row,
    so both agree when nothing is late. :func:`late_counts` tells how many rows that were.
    """
    timed = samples.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    x = F.col(value)
    return timed.groupBy(key, F.window("_ts", width).alias("bin")).agg(
        F.sum(x * x).alias("energy_sum"), F.count(x).alias("sample_count"), F.max(F.abs(x)).alias("peak")
    ).select(
        key, F.unix_micros("bin.start").alias("bin_start_us"), "energy_sum", "sample_count", "peak"
    )


def count_arrivals(samples: DataFrame, key: str, ts: str, value: str, folder: str, checkpoint: str, *, width: str) -> StreamingQuery:
    """Side count of all rows of a stream, late ones too: one small table per micro-batch, no state and no watermark.

    A batch that runs again overwrites its own folder, so every row is counted once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        at = F.col(ts).cast("timestamp")
        counted = batch.withColumn("_ts", at).groupBy(key, F.window("_ts", width).alias("bin")).agg(
            F.count(value).alias("arrived"), F.max(F.unix_micros("_ts")).alias("latest_us")
        )
        rows = counted.select(key, F.unix_micros("bin.start").alias("bin_start_us"), "arrived", "latest_us")
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = samples.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_counts(emitted: DataFrame, arrivals: DataFrame, key: str, *, width_us: int, delay_us: int) -> DataFrame:
    """Bins that the watermark has closed, with the rows that came too late for them.

    A closed bin that the stream never emitted got all its rows late. ``arrivals`` are the tables of
    :func:`count_arrivals` over the same stream; the watermark follows from the latest time in them.
    """
    total = arrivals.groupBy(key, "bin_start_us").agg(F.sum("arrived").alias("_arrived"))
    closed = arrivals.agg((F.floor(F.max("latest_us") / 1000) * 1000 - delay_us).alias("w")).scalar()
    bins = total.filter(F.col("bin_start_us") + width_us <= closed).withColumnRenamed(key, "_key").withColumnRenamed("bin_start_us", "_bin")
    same = F.col("_key").eqNullSafe(F.col(key)) & (F.col("_bin") == F.col("bin_start_us"))
    rest = [c for c in emitted.columns if c not in (key, "bin_start_us", "energy_sum", "sample_count")]
    out = bins.join(emitted, same, "left")
    taken = F.coalesce("sample_count", F.lit(0))
    return out.select(
        F.col("_key").alias(key), F.col("_bin").alias("bin_start_us"), F.coalesce("energy_sum", F.lit(0.0)).alias("energy_sum"), taken.alias("sample_count"), *rest,
        (F.col("_arrived") - taken).alias("late_count"),
    )


def smooth_levels(bins: DataFrame, key: str, width_us: int, weights: Sequence[float]) -> DataFrame:
    """Adds ``level_db`` of energies and counts summed with ``weights`` over the bins around each one (absent bins: nothing).

    The batch step after the stream; NULL where no neighbour has a sample.
    """
    indexed = bins.withColumn("_at", F.floor(F.col("bin_start_us") / width_us))
    out = weighted_frame(indexed, [key], "_at", {"_energy": F.col("energy_sum"), "_count": F.col("sample_count")}, weights)
    mean = F.col("_energy") / F.col("_count")
    return out.withColumn("level_db", F.when(F.col("_count") > 0, 10.0 * F.log10(F.greatest(mean, F.lit(1e-14))))).drop("_at", "_energy", "_count")


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Drain what is available into Parquet with exactly-once file output."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
