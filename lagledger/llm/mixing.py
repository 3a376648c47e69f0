"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagledger.llm.common import HASH_BITS, WORD, cells_for, draw, key_of, own_names, running, text_of
from lagledger.session import broadcast_if_small, cut_lineage

GRID = 1 << 16  # exponents are multiples of 1 / GRID
FAN = 32  # exponents tried per job
ENTROPY_SHARE = 0.99
MOST_PASSES = 2.0
BLOCK_TOKENS = 1 << 20


def _measures(sources: DataFrame, ks: list[int]) -> dict[int, tuple[float, float]]:
    """For each exponent k / GRID: (entropy of the weights, most passes over a source when each gets one at least)."""
    a = F.col("__k") / GRID
    rows = (
        sources.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in ks])))
        .groupBy("__k")
        .agg(
            F.sum(F.pow("__p", a)).alias("z"),
            F.sum(F.pow("__p", a) * F.log("__p")).alias("zl"),
            F.max(F.pow("__p", a - 1)).alias("high"),
            F.min(F.pow("__p", a - 1)).alias("low"),
        )
    )
    return {r["__k"]: (math.log(r["z"]) - r["__k"] / GRID * r["zl"] / r["z"], r["high"] / r["low"]) for r in rows.collect()}


def _bisect(sources: DataFrame, low_side: bool, holds) -> int:
    """Smallest (``low_side`` false) or largest k in 0..GRID at which ``holds``; it changes once along k.

    Each job tries FAN exponents inside the bracket, which narrows FAN + 1 times as fast as one does. ``holds`` is
    taken to be true at 0 where ``low_side`` is true and at GRID otherwise.
    """
    low, high = (0, GRID + 1) if low_side else (-1, GRID)
    while high - low > 1:
        step = (high - low) / (FAN + 1)
        ks = sorted({min(high - 1, max(low + 1, round(low + step * (i + 1)))) for i in range(FAN)})
        got = _measures(sources, ks)
        for k in ks:
            if holds(*got[k]) == low_side:
                low = k
            else:
                high = k
                break
    return low if low_side else high


def temperature(sources: DataFrame, entropy_share: float | None = ENTROPY_SHARE, most_passes: float | None = MOST_PASSES) -> float:
    """The exponent in [0, 1] for token shares ``__p``.

    The largest one whose weights have at least ``entropy_share`` of the largest possible entropy, ln(sources); not
    below the smallest at which no source is passed more than ``most_passes`` times. None leaves a condition out; without either the exponent is 1.
    """
    n = sources.count()
    if n < 2:
        return 1.0
    if entropy_share is None and most_passes is None:
        return 1.0
    k = 0 if entropy_share is None else _bisect(sources, True, lambda h, _: h >= entropy_share * math.log(n) - 1e-12)
    if most_passes is not None:
        k = max(k, _bisect(sources, False, lambda _, r: r <= most_passes + 1e-12))
    return k / GRID


def _narrow(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        key_of(F.col(source_col)).alias("__key"),
        (F.regexp_count(text_of(text_col), F.lit(WORD)) + 1).cast("long").alias("__tokens"),
    )


def _quotas(rows: DataFrame, entropy_share: float | None, most_passes: float | None) -> DataFrame:
    """Per source: __total tokens, __weight, __quota tokens, __full passes and __rest tokens of the next pass."""
    sums = cut_lineage(rows.groupBy("__key").agg(F.sum("__tokens").alias("__total")))
    whole = sums.agg(F.sum("__total")).first()[0] or 1
    sources = sums.withColumn("__p", F.col("__total") / F.lit(float(whole)))
    a = temperature(sources, entropy_share, most_passes)
    scale = sources.agg(F.sum(F.pow("__p", F.lit(a))), F.min(F.pow("__p", F.lit(a - 1)))).first()
    quota = F.floor(F.col("__total") * (F.pow("__p", F.lit(a - 1)) / F.lit(scale[1] or 1.0)) + 0.5).cast("long")
    return (
        sources.withColumn("__weight", F.pow("__p", F.lit(a)) / F.lit(scale[0] or 1.0))
        .withColumn("__quota", F.greatest(quota, F.col("__total")))
        .withColumn("__full", F.expr("__quota div __total"))
        .withColumn("__rest", F.expr("__quota % __total"))
    )


def _passes(rows: DataFrame, quotas: DataFrame, seed: int, cells: int, only_rest: bool) -> DataFrame:
    """Rows of each pass with ``__at``, the tokens of its source's stream before them.

    Every pass is a new permutation of the source; the last one ends with the document that reaches the quota.
    """
    first = F.col("__full") if only_rest else F.lit(0)
    last = F.when(F.col("__rest") > 0, F.col("__full")).otherwise(F.col("__full") - 1)
    out = rows.join(broadcast_if_small(quotas), "__key").filter(first <= last)
    out = out.withColumn("__pass", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    out = out.withColumn("__draw", draw(seed, F.col("__pass"), F.col("__id")))
    out = out.withColumn("__cell", F.floor(F.col("__draw") / (1 << HASH_BITS) * cells))
    out = running(out, ["__key", "__pass"], "__cell", ["__draw", "__id", "__tokens"], {"__done": F.col("__tokens")})
    out = out.withColumn("__at", F.col("__pass") * F.col("__total") + F.col("__done"))
    return out.filter(F.col("__at") < F.col("__quota"))


def mix(
    docs: DataFrame,
    entropy_share: float | None = ENTROPY_SHARE,
    most_passes: float | None = MOST_PASSES,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per emitted document: ``id_col``, source, tokens, target_weight, pass, block, position.

    Source weights are the token shares to the power of :func:`temperature`, normalised. The budget is the least with
    which each source is passed once, so no document is lost and small sources repeat up to ``most_passes`` times.
    A source's stream is one seeded permutation per pass; the budget is dealt to blocks of about ``block_tokens``, each
    of which takes the weight's share from every source's stream and is permuted inside.

    A document counts its words plus one. Edge cases: a null or empty text counts one token; null sources form one
    source; one source, or none, gives its rows once; rows that repeat an id are emitted each; other columns are ignored.
    """
    rows = cut_lineage(_narrow(docs, seed, id_col, text_col, source_col))
    quotas = cut_lineage(_quotas(rows, entropy_share, most_passes))
    budget = quotas.agg(F.sum("__quota")).first()[0] or 0
    blocks = max(1, -(-budget // block_tokens))
    out = _passes(rows, quotas, seed, cells_for(rows.count()), False)
    out = out.withColumn("__block", F.least(F.floor(F.col("__at") / F.col("__quota") * blocks), F.lit(blocks - 1)))
    # a block holds block_tokens tokens, and a document one at least, so one task may order it
    inside = Window.partitionBy("__block").orderBy("__draw", "__key", "__id", "__pass")
    out = out.withColumn("__position", F.row_number().over(inside) - 1)
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__source").alias("source"),
        F.col("__tokens").alias("tokens"),
        F.round("__weight", 6).alias("target_weight"),
        F.col("__pass").alias("pass"),
        F.col("__block").cast("long").alias("block"),
        F.col("__position").cast("long").alias("position"),
    )


@own_names
def mixed_rows(
    docs: DataFrame,
    entropy_share: float | None = ENTROPY_SHARE,
    most_passes: float | None = MOST_PASSES,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` emits it, with all their columns.

    The last pass of a source is a prefix of its permutation, so the place where it ends says it all: one row per
    source goes to the texts and no text is shuffled.
    """
    rows = cut_lineage(_narrow(docs, seed, id_col, text_col, source_col))
    quotas = cut_lineage(_quotas(rows, entropy_share, most_passes))
    ends = _passes(rows, quotas, seed, cells_for(rows.count()), True).groupBy("__key").agg(F.max(F.struct("__draw", "__id")).alias("__end"))
    ends = cut_lineage(quotas.select("__key", "__full").join(ends, "__key", "left"))
    place = F.struct(draw(seed, F.col("__full"), F.col(id_col)).alias("__draw"), F.col(id_col).alias("__id"))
    times = F.col("__full") + F.when(place <= F.col("__end"), 1).otherwise(0)
    out = docs.withColumn("__key", key_of(F.col(source_col))).join(broadcast_if_small(ends), "__key")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*[F.col(c) for c in docs.columns])
