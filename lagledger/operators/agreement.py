"""Rater votes: majority, plurality, kappa, agreement with a machine label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """Strict majority of all raters for yes or no, else ambiguous; needs two raters."""
    yes, no = F.count_if(F.col(vote) == "yes"), F.count_if(F.col(vote) == "no")
    table = votes.groupBy(item).agg(
        F.count(F.lit(1)).alias("raters"), yes.alias("yes_votes"), no.alias("no_votes"),
        F.count_if(F.col(vote) == "ambiguous").alias("ambiguous_votes"),
    )
    need = F.floor(F.col("raters") / 2) + 1
    top = F.greatest("yes_votes", "no_votes", "ambiguous_votes")
    return table.withColumns(
        {
            "consensus": F.when(F.col("raters") < 2, F.lit(None)).when(F.col("yes_votes") >= need, "yes")
            .when(F.col("no_votes") >= need, "no").otherwise("ambiguous"),
            "unanimous": top == F.col("raters"),
        }
    )


def plurality(votes: DataFrame, item: str, vote: str, unknown: str = "unknown") -> DataFrame:
    """Most frequent label after dropping unknown; a tie gives unknown."""
    counts = votes.groupBy(item, vote).agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col(vote) != unknown, F.col("_n"))
    best = counts.groupBy(item).agg(F.max(known).alias("_top"), F.max_by(vote, known).alias("_label"))
    ties = counts.join(best, item).groupBy(item, "_label").agg(
        F.count_if((F.col("_n") == F.col("_top")) & (F.col(vote) != unknown)).alias("_ties")
    )
    return ties.select(item, F.when(F.col("_ties") == 1, F.col("_label")).otherwise(unknown).alias("label"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, categories: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Observed agreement and kappa of two raters over a fixed category list; NULL if chance is 1."""
    n = F.count(F.lit(1))
    chance = F.lit(0.0)
    for c in categories:
        chance = chance + (F.count_if(F.col(a) == c) / n) * (F.count_if(F.col(b) == c) / n)
    table = pairs.groupBy(*keys).agg(
        n.alias("items"), (F.count_if(F.col(a) == F.col(b)) / n).alias("observed"), chance.alias("expected")
    )
    spare = F.lit(1.0) - F.col("expected")
    return table.withColumn(
        "kappa", F.when(F.abs(spare) > 1e-15, (F.col("observed") - F.col("expected")) / spare)
    )


def rater_pairs(votes: DataFrame, item: str, rater: str, vote: str) -> DataFrame:
    """One row per item and ordered rater pair (two to four raters per item)."""
    left = votes.select(item, F.col(rater).alias("rater_a"), F.col(vote).alias("vote_a"))
    right = votes.select(item, F.col(rater).alias("rater_b"), F.col(vote).alias("vote_b"))
    return left.join(right, item).filter(F.col("rater_a") < F.col("rater_b"))


def fleiss_kappa(votes: DataFrame, item: str, vote: str, categories: Sequence[str]) -> DataFrame:
    """Fleiss kappa; fails when items have unequal rater counts."""
    per_item = votes.groupBy(item).agg(
        F.count(F.lit(1)).alias("_r"), *[F.count_if(F.col(vote) == c).alias(f"_c{i}") for i, c in enumerate(categories)]
    )
    squares = sum((F.col(f"_c{i}") * F.col(f"_c{i}") for i in range(len(categories))), F.lit(0))
    agree = (squares - F.col("_r")) / (F.col("_r") * (F.col("_r") - 1))
    total = per_item.agg(
        F.count(F.lit(1)).alias("items"), F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), F.avg(agree).alias("observed"),
        *[(F.sum(f"_c{i}") / F.sum("_r")).alias(f"_p{i}") for i in range(len(categories))],
    )
    expected = sum((F.col(f"_p{i}") * F.col(f"_p{i}") for i in range(len(categories))), F.lit(0.0))
    spare = F.lit(1.0) - expected
    equal = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.lit("unequal rater counts")).cast("double")).otherwise(F.col("observed"))
    return total.select(
        "items", equal.alias("observed"), expected.alias("expected"),
        F.when(F.abs(spare) > 1e-15, (F.col("observed") - expected) / spare).alias("kappa"),
    )


def machine_agreement(rows: DataFrame, human: str, machine: str, human_post: str, machine_post: str) -> DataFrame:
    """Agreement of a review with the machine label: category, presence of contact, post-audio-only."""
    h, m, post = F.col(human), F.col(machine), F.col(human_post)
    positive = lambda c: c.isin("weak_contact", "strong_contact")
    same = lambda cond: F.when(cond, "match").otherwise("mismatch")
    unclear = F.when(h == "ambiguous", "ambiguous")
    decided = post.isin("true", "false") & positive(h)
    return rows.withColumns(
        {
            "category_agreement": F.coalesce(unclear, same(h.eqNullSafe(m))),
            "presence_agreement": F.coalesce(unclear, same(positive(h).eqNullSafe(positive(m)))),
            "post_only_agreement": F.when(decided, same((post == "true").eqNullSafe(F.col(machine_post))))
            .when(post == "ambiguous", "ambiguous").otherwise("not_applicable"),
        }
    )


def needs_followup(rows: DataFrame, contact: str, timing: str) -> DataFrame:
    """Annotations to review again: no contact, or contact only after the audio or unclear."""
    return rows.filter((F.col(contact) == "no") | F.col(timing).isin("after_only", "ambiguous"))
