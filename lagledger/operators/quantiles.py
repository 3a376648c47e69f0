"""Exact quantiles (linear interpolation) that survive one very large group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagledger.session import cut_lineage

HOT_ROWS = 20_000_000
# Rank error of percentile_approx is at most n / accuracy.
ACCURACY = 20_000


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    columns: Mapping[str, float],
    *,
    extra: Sequence[Column] = (),
    max_rows: int | None = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """One row per key: exact quantiles of the non-null values, plus ``extra`` aggregates.

    ``percentile`` keeps all distinct values of a group in one task, which is
    right for small groups only. Groups above ``max_rows`` (at most total /
    max_rows of them, hence a small broadcast) take a second way: a quantile
    sketch brackets each wanted rank, rows below the bracket are only counted,
    and the few inside are ranked. ``probe`` may be a cheaper frame with the
    same keys and at least as many rows per key; it is only counted.
    ``max_rows=None`` skips the count where the caller knows groups are small.
    """
    keys, extra = list(keys), list(extra)
    simple = lambda part: part.groupBy(*keys).agg(
        *[F.percentile(value, q).alias(n) for n, q in columns.items()], *extra
    )
    if max_rows is None:
        return simple(df)
    counted = df.filter(F.col(value).isNotNull()) if probe is None else probe
    hot = counted.groupBy(*keys).count().filter(F.col("count") > max_rows).drop("count")
    if hot.isEmpty():
        return simple(df)
    hot = cut_lineage(hot)
    big = cut_lineage(df.join(F.broadcast(hot), keys, "left_semi"))
    cold = df.join(F.broadcast(hot), keys, "left_anti")
    return simple(cold).unionByName(_bracketed(big, keys, value, columns, extra))


def _bracketed(
    df: DataFrame, keys: list[str], value: str, columns: Mapping[str, float], extra: list[Column]
) -> DataFrame:
    names, fractions = list(columns), list(columns.values())
    pad = 3.0 / ACCURACY
    low = [max(0.0, q - pad) for q in fractions]
    high = [min(1.0, q + pad) for q in fractions]
    v = F.col(value)
    frame = df.groupBy(*keys).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(v, low, ACCURACY).alias("_low"),
        F.percentile_approx(v, high, ACCURACY).alias("_high"),
        F.min(v).alias("_min"), F.max(v).alias("_max"), *extra,
    )
    # With few rows the pad is below one rank, so the bracket is all of them.
    few = F.col("_n") <= ACCURACY
    wanted = frame.select(
        *keys, "_n",
        F.posexplode(
            F.arrays_zip(
                F.array(*[F.lit(q) for q in fractions]).alias("q"), F.col("_low").alias("lo"),
                F.col("_high").alias("hi"),
            )
        ).alias("_i", "_w"),
        "_min", "_max",
    ).select(
        *keys, "_i",
        (F.col("_w.q") * (F.col("_n") - 1)).alias("_rank"),
        F.when(few, F.col("_min")).otherwise(F.col("_w.lo")).alias("_lo"),
        F.when(few, F.col("_max")).otherwise(F.col("_w.hi")).alias("_hi"),
    )
    brackets = wanted.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_rank", "_lo", "_hi"))).alias("_b")
    )
    # The bracket list has one entry per wanted fraction.
    marked = df.filter(v.isNotNull()).join(brackets, keys).select(
        *keys, v.alias("_v"), F.explode("_b").alias("_e")
    ).filter(F.col("_v") <= F.col("_e._hi"))
    inside = F.col("_v") >= F.col("_e._lo")
    # Equal values are folded map-side; all rows below a bracket fold to one.
    folded = marked.groupBy(
        *keys, F.col("_e._i").alias("_i"), F.col("_e._rank").alias("_rank"),
        F.when(inside, F.col("_v")).alias("_x"),
    ).agg(F.count(F.lit(1)).alias("_w"))
    order = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_x"))
    ranked = folded.withColumn("_upto", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.floor("_rank"), F.ceil("_rank")
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_w") <= rank)
    points = ranked.filter(F.col("_x").isNotNull()).groupBy(*keys, "_i", "_rank").agg(
        F.max(F.when(holds(first), F.col("_x"))).alias("_a"),
        F.max(F.when(holds(last), F.col("_x"))).alias("_z"),
    )
    share = F.col("_rank") - F.floor("_rank")
    picked = points.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_i") == i, F.col("_a") + (F.col("_z") - F.col("_a")) * share)).alias(n)
            for i, n in enumerate(names)
        ]
    )
    return frame.drop("_n", "_low", "_high", "_min", "_max").join(picked, keys, "left").select(
        *keys, *names, *[c for c in frame.columns if c not in {*keys, "_n", "_low", "_high", "_min", "_max"}]
    )


def median_and_mad(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    median: str = "median",
    mad: str = "mad",
    extra: Sequence[Column] = (),
    max_rows: int | None = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Median and unscaled median absolute deviation per key."""
    middle = quantiles(df, keys, value, {median: 0.5}, extra=extra, max_rows=max_rows, probe=probe)
    # As one struct, keys with NULLs meet too.
    as_one = F.struct(F.lit(0).alias("_"), *keys)
    away = df.withColumn("_keys", as_one).join(middle.select(as_one.alias("_keys"), F.col(median).alias("_mid")), "_keys").withColumn(
        "_away", F.abs(F.col(value) - F.col("_mid"))
    )
    spread = quantiles(away, keys, "_away", {mad: 0.5}, max_rows=max_rows, probe=probe)
    return middle.withColumn("_keys", as_one).join(spread.select(as_one.alias("_keys"), mad), "_keys", "left").drop("_keys")


def distribution(df: DataFrame, keys: Sequence[str], value: str, max_rows: int | None = HOT_ROWS) -> DataFrame:
    """Count, mean, p05, p25, median, p75, p95 and interquartile range; empty gives NULLs."""
    table = quantiles(
        df, keys, value, {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95},
        extra=[F.count(value).alias("count"), F.avg(value).alias("mean")], max_rows=max_rows,
    )
    return table.withColumn("iqr", F.col("p75") - F.col("p25"))
