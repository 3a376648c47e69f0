"""Ordering, picks and deterministic shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagledger.operators.scan import Slicing, global_index, scan


def top_candidates(cands: DataFrame, event: str, k: int, *, target: Column, score: str, time: str, selected: Column) -> DataFrame:
    """Display list per event: target first, then score; the selected row replaces the last if cut.

    Decisions must be taken on the untruncated list before this.
    """
    by = Window.partitionBy(event).orderBy(F.desc(target), F.desc(score), time)
    ranked = cands.withColumn("display_rank", F.row_number().over(by)).withColumn("_sel", selected)
    cut = F.max(F.when(F.col("_sel") & (F.col("display_rank") > k), 1)).over(Window.partitionBy(event)).isNotNull()
    keep = (F.col("display_rank") <= F.when(cut, k - 1).otherwise(k)) | F.col("_sel")
    return ranked.withColumn("_keep", keep).filter("_keep").drop("_keep", "_sel")


def best_and_margin(
    scores: DataFrame, item: str, label: str, score: str, *, minimum: float = 0.55, margin: float = 0.12
) -> DataFrame:
    """Best, runner-up and margin per item; accepted only if strong and clear, else ``unknown``.

    Two rows per item survive each partial aggregate, so an item with many
    labels is no hot spot.
    """
    entry = F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))
    first = scores.groupBy(item).agg(F.min(entry).alias("_b"))
    rest = scores.join(first, item).filter(F.col(label) != F.col("_b.l")).groupBy(item).agg(F.max(score).alias("runner_up"))
    out = first.join(rest, item, "left").select(
        item, F.col("_b.l").alias("best_label"), (-F.col("_b.s")).alias("best_score"),
        F.coalesce("runner_up", F.lit(0.0)).alias("runner_up_score"),
    ).withColumn("margin", F.col("best_score") - F.col("runner_up_score"))
    ok = (F.col("best_score") >= minimum) & (F.col("margin") >= margin)
    return out.withColumn("accepted", ok).withColumn("label", F.when(ok, F.col("best_label").cast("string")).otherwise("unknown"))


def blind_shuffle(events: DataFrame, ident: str, seed: int, prefix: str = "AR-", digits: int = 4) -> DataFrame:
    """Deterministic shuffled ids: order by SHA-256 of seed and id.

    Hash order is uniform, so its leading hex digits cut the rows into even
    slices; positions are counted per slice, not in one task.
    """
    hashed = events.withColumn(
        "_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256)
    ).withColumn("_head", F.conv(F.substring("_hash", 1, 10), 16, 10).cast("long"))
    placed = global_index(hashed, "_head", Slicing(width=2**40 / 4096), ties=["_hash", ident], name="_at")
    number = (F.col("_at") + 1).cast("string")
    padded = F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))
    return placed.withColumn("blind_id", F.concat(F.lit(prefix), padded)).withColumn(
        "blind_order", F.col("_at") + 1
    ).drop("_hash", "_head", "_at")


def first_n(rows: DataFrame, n: int, order: str, slicing: Slicing, *, eligible: Column, ties: Sequence[str]) -> DataFrame:
    """The first n eligible rows are selected, later ones deferred, the rest excluded; all stay."""
    flagged = rows.withColumn("_ok", eligible.cast("long"))
    counted = scan(flagged, [], order, slicing, ties=ties, running={"_seen": F.col("_ok")})
    return counted.withColumn(
        "status", F.when(F.col("_ok") == 0, "excluded").when(F.col("_seen") <= n, "selected").otherwise("deferred")
    ).drop("_ok", "_seen")


def spread_pick(rows: DataFrame, k: int, order: str, slicing: Slicing, *, ties: Sequence[str]) -> DataFrame:
    """k evenly spaced positions, both ends included (all rows if there are fewer)."""
    placed = global_index(rows, order, slicing, ties=ties)
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    n = F.least(F.col("_n"), F.lit(k))
    picks = total.select(
        F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).alias("pick"), "_n", n.alias("_k")
    ).filter(F.col("_n") > 0).select(
        "pick",
        F.when(F.col("_k") == 1, F.lit(0)).otherwise(F.floor(F.col("pick") * (F.col("_n") - 1) / (F.col("_k") - 1))).cast("long").alias("position"),
    )
    # k rows at most on this side.
    return placed.join(F.broadcast(picks), "position")


def chronology_breaks(rows: DataFrame, time: str, order: str, slicing: Slicing, *, ties: Sequence[str] = ()) -> DataFrame:
    """Rows whose time is below that of the row before them in ``order``."""
    marked = scan(rows, [], order, slicing, ties=ties, before={"_was": F.col(time)})
    return marked.filter(F.col(time) < F.col("_was")).drop("_was")


def nearest_with_ties(deltas: DataFrame, metric: str, delta: str, tolerance: float = 1e-12) -> DataFrame:
    """Per metric, all rows whose |delta| is the smallest within an absolute or relative tolerance."""
    known = deltas.filter(F.col(delta).isNotNull())
    least = known.groupBy(metric).agg(F.min(F.abs(delta)).alias("_least"))
    d = F.abs(delta)
    close = d - F.col("_least") <= F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(d, F.col("_least")))
    return known.join(least, metric).filter(close).drop("_least")


def pick_by_priority(cands: DataFrame, event: str, priority: Sequence[Column]) -> DataFrame:
    """The lexicographically smallest candidate per event (partial aggregation, no sort)."""
    value = F.struct(*[F.col(c) for c in cands.columns if c != event])
    return cands.groupBy(event).agg(F.min_by(value, F.struct(*priority)).alias("_p")).select(event, "_p.*")


def earliest_equivalent(members: DataFrame, event: str, *, gates: Column, margin: float = 1.5) -> DataFrame:
    """Earliest member nearly as good as the top one with at least its flux, else the top."""
    value = F.struct(*[F.col(c) for c in members.columns if c != event])
    top = members.groupBy(event).agg(F.min_by(value, F.struct(-F.col("score"), F.col("time_s"))).alias("_top"))
    fits = (F.col("score") >= F.col("_top.score") - margin) & (F.col("spectral_flux_z") >= F.col("_top.spectral_flux_z")) & gates
    early = members.join(top, event).groupBy(event).agg(
        F.min_by(value, F.when(fits, F.col("time_s"))).alias("_early"), F.first("_top").alias("_top")
    )
    return early.select(event, F.coalesce("_early", "_top").alias("_s")).select(event, "_s.*")
