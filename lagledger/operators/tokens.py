"""Words to target tokens, votes and label intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagledger.functions import text as tx
from lagledger.operators.nearest import point_in_interval
from lagledger.operators.quantiles import quantiles
from lagledger.operators.rules import passes, reasons
from lagledger.operators.scan import Slicing, global_index, runs, scan
from lagledger.session import broadcast_if_small, cut_lineage


def explode_words(transcripts: DataFrame, source: str, segments: str = "segments") -> DataFrame:
    """segments[].words[] in transcript order; ``word_order`` runs over segment borders (segment above 32 bits of word)."""
    seg = transcripts.select(source, F.posexplode(segments).alias("segment_pos", "s"))
    words = seg.select(source, "segment_pos", "s.id", "s.no_speech_prob", F.posexplode("s.words").alias("word_pos", "w"))
    return words.select(
        source, F.col("id").alias("segment_id"), "no_speech_prob", "segment_pos", "word_pos", "w.*",
        (F.shiftleft(F.col("segment_pos").cast("long"), 32) + F.col("word_pos")).alias("word_order"),
    )


def neighbour_windows(
    words: DataFrame, keys: Sequence[str], order: str, start: str, end: str, slicing: Slicing, *, ties: Sequence[str] = ()
) -> DataFrame:
    """Previous and next word span in global order; an invalid span is NULL but keeps its place."""
    valid = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) >= 0) & (F.col(end) > F.col(start))
    span = F.when(valid, F.struct(F.col(start).alias("start_s"), F.col(end).alias("end_s")))
    return scan(
        words, keys, order, slicing, ties=ties, before={"previous_window": span}, after={"next_window": span}
    )


def occurrences(
    words: DataFrame, reading: str, start: str, end: str, letters: str = tx.P_LETTERS + tx.B_LETTERS
) -> DataFrame:
    """One row per target letter in a word's reading, with the anchors of all of them."""
    at = tx.target_positions(reading, letters)
    anchors = F.transform("_at", lambda p: tx.proportional_anchor(reading, p, start, end))
    return (
        words.withColumn("_at", at)
        .withColumn("occurrence_anchors", anchors)
        .select("*", F.posexplode(F.array_compact("_at")).alias("occurrence_index", "character_index"))
        .withColumn("letter", F.substring(F.col(reading), F.col("character_index") + 1, F.lit(1)))
        .withColumn("anchor_s", F.get("occurrence_anchors", F.col("occurrence_index")))
        .drop("_at")
    )


def target_tokens(
    words: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    order: str,
    slicing: Slicing,
    *,
    cutoff: float,
    minimum_probability: float = 0.75,
    maximum_no_speech: float = 1.0,
    guard: float = 0.75,
    p_letters: str = tx.P_LETTERS,
    b_letters: str = tx.B_LETTERS,
    interval_width: float = 3600.0,
) -> DataFrame:
    """Every target letter of every word with its label interval and the rules it fails.

    Words need ``word, reading, start, end, probability, no_speech_prob``.
    Tokens outside all intervals or below a threshold are returned too.
    """
    spoken = F.nullif(F.trim("reading"), F.lit(""))
    # NFKC leaves ASCII alone, so plain words without a target letter need no Python.
    raw = F.coalesce(spoken, F.col("word"))
    words = words.filter(raw.rlike("[^\\x00-\\x7F]") | raw.rlike(f"[{p_letters}{b_letters}]"))
    read = words.withColumn("reading_text", tx.nfkc(F.coalesce(spoken, F.col("word")))).withColumn(
        "reading_source", F.when(spoken.isNotNull(), "reading").otherwise("surface_word")
    )
    timed = read.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    found = occurrences(timed, "reading_text", "start", "end", p_letters + b_letters).withColumn(
        "phoneme_class", tx.target_class("letter", p_letters, b_letters)
    )
    # The match reads its input three times (count, rows, borders): keep the tokens.
    found = cut_lineage(found)
    placed = point_in_interval(
        found, intervals, keys, "anchor_s", "start_s", "end_s", Slicing(width=interval_width), tie="interval_id", guard=guard
    )
    rules = reasons(
        (F.col("anchor_s") >= cutoff, "after_interview_cutoff"),
        (F.coalesce("probability", F.lit(0.0)) < minimum_probability, "low_asr_probability"),
        (F.col("no_speech_prob") > maximum_no_speech, "high_segment_no_speech_probability"),
        (F.col("placement") == "outside", "outside_labeled_speaker_interval"),
        (F.col("placement") == "near_transition", "near_active_speaker_transition"),
    )
    return placed.withColumn("exclusion_reasons", rules).withColumn("eligible", passes("exclusion_reasons"))


def number_tokens(tokens: DataFrame, order: str, slicing: Slicing, ties: Sequence[str], prefix: str = "pb-") -> DataFrame:
    """Serial ids in order, counted slice by slice."""
    placed = global_index(cut_lineage(tokens), order, slicing, ties=ties, name="_at")
    text = (F.col("_at") + 1).cast("string")
    return placed.withColumn(
        "token_id", F.concat(F.lit(prefix), F.when(F.length(text) >= 4, text).otherwise(F.lpad(text, 4, "0")))
    ).drop("_at")


def reading_audit(
    words: DataFrame, keys: Sequence[str], word: str, reading: str, order: str, examples: int = 20, ties: Sequence[str] = ()
) -> DataFrame:
    """Words with and without a reading, first missing examples and the scope they allow."""
    present = F.nullif(F.trim(reading), F.lit("")).isNotNull()
    counts = words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("word_count"), F.count_if(present).alias("with_reading"),
        F.count_if(~present).alias("missing_reading"),
    )
    # Numbered slice by slice, so the list below holds ``examples`` rows per key.
    missing = words.filter(~present).select(*keys, order, *ties, word)
    numbered = scan(missing, keys, order, Slicing(width=100_000), ties=ties, index="_i").filter(F.col("_i") < examples)
    shown = numbered.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, *ties, word))), lambda s: s[word]).alias("missing_examples")
    )
    return counts.join(shown, list(keys), "left").withColumn(
        "inventory_scope", F.when(F.col("missing_reading") == 0, "complete_readings").otherwise("explicit_targets_only")
    )


def target_times(events: DataFrame, keys: Sequence[str], time: str, *, step: int, offsets: Sequence[int]) -> DataFrame:
    """Distinct grid times and event times shifted by the offsets, inside the key's range."""
    bounds = events.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    grid = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("long"))).alias(time))
    shifted = events.select(*keys, F.explode(F.array(*[F.col(time) + F.lit(o) for o in offsets])).alias(time))
    inside = shifted.join(bounds, list(keys)).filter(F.col(time).between(F.col("_lo"), F.col("_hi"))).select(*keys, time)
    return grid.unionByName(inside).distinct()


def compress_intervals(
    samples: DataFrame, keys: Sequence[str], time: str, label: str, slicing: Slicing, *,
    half_step: float, start: Column, end: Column, score: str, margin: str, ties: Sequence[str] = (),
) -> DataFrame:
    """Runs of equal label as intervals; borders half a step before a run's first sample, ends clamped."""
    numbered = runs(samples, keys, time, slicing, F.col(label), ties=ties, name="interval_index")
    by = [*keys, "interval_index", label]
    table = quantiles(
        numbered, by, score, {"median_score": 0.5}, max_rows=20_000_000,
        extra=[
            F.min(time).alias("_first"), F.count(F.lit(1)).alias("sample_count"), F.min(margin).alias("minimum_margin"),
        ],
    )
    edges = scan(table, keys, "interval_index", Slicing(width=100_000), after={"_next": F.col("_first")})
    opened = F.when(F.col("interval_index") == 1, start).otherwise(F.col("_first") - half_step)
    closed = F.when(F.col("_next").isNull(), end).otherwise(F.col("_next") - half_step)
    return edges.withColumn("start", F.greatest(start, opened)).withColumn("end", F.least(end, closed)).drop("_first", "_next")


def stable_label(observations: DataFrame, item: str, label: str, guard: str) -> DataFrame:
    """Unanimous core votes other than unknown, confirmed by at least one guard vote and all of them.

    ``guard`` is a boolean column: true for guard votes, false for core votes.
    """
    core, g = ~F.col(guard), F.col(guard)
    known = F.when(core, F.col(label))
    table = observations.groupBy(item).agg(
        F.min(known).alias("_lo"), F.max(known).alias("_hi"), F.count_if(g).alias("guard_votes"),
        F.min(F.when(g, F.col(label))).alias("_glo"), F.max(F.when(g, F.col(label))).alias("_ghi"),
    )
    unanimous = F.coalesce((F.col("_lo") == F.col("_hi")) & (F.col("_lo") != "unknown"), F.lit(False))
    confirmed = (F.col("guard_votes") > 0) & (F.col("_glo") == F.col("_lo")) & (F.col("_ghi") == F.col("_lo"))
    return table.select(
        item, F.when(unanimous, F.col("_lo")).otherwise("unknown").alias("label"),
        (unanimous & F.coalesce(confirmed, F.lit(False))).alias("stable"),
    )


def template_match(
    items: DataFrame, templates: DataFrame, item: str, label: str, shingles: str, *, minimum: float = 0.55, margin: float = 0.12
) -> DataFrame:
    """Dice of every item to every template via shared shingles, then the best-and-margin rule.

    Only (item, template) pairs with a common shingle are formed; the others
    score zero, which the margin rule takes as runner-up.
    """
    from lagledger.operators.ranking import best_and_margin

    a = items.select(item, F.array_distinct(shingles).alias("_s")).withColumn("_na", F.size("_s"))
    b = templates.select(label, F.array_distinct(shingles).alias("_s")).withColumn("_nb", F.size("_s"))
    # Exploding a computed array keeps the optimizer from adding a size filter
    # that would work the shingles out twice per text.
    left = a.select(item, "_na", F.explode(F.array_compact("_s")).alias("_g"))
    # Templates are few; they are broadcast only if that proves true.
    right = broadcast_if_small(b.select(label, "_nb", F.explode("_s").alias("_g")))
    common = left.join(right, "_g").groupBy(item, label, "_na", "_nb").agg(F.count(F.lit(1)).alias("_c"))
    scores = common.select(item, label, (2.0 * F.col("_c") / (F.col("_na") + F.col("_nb"))).alias("score"))
    # Best and runner-up are two aggregates over the scores: compute those once.
    best = best_and_margin(cut_lineage(scores), item, label, "score", minimum=minimum, margin=margin)
    return items.select(item).join(best, item, "left").fillna({"label": "unknown"})


def manifest_summary(tokens: DataFrame, samples: DataFrame, label: str) -> DataFrame:
    """Unknown share of the timeline and token counts per label (long form)."""
    unknown = samples.agg(
        F.try_divide(F.count_if(F.col(label) == "unknown").cast("double"), F.count(F.lit(1)).cast("double")).alias("value")
    ).select(F.lit("unknown_fraction").alias("item"), F.lit("all").alias("name"), "value")
    per_label = tokens.groupBy(F.col(label).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("tokens").alias("item"), "name", "value"
    )
    stable = tokens.agg(F.count_if("stable").cast("double").alias("value")).select(
        F.lit("stable_tokens").alias("item"), F.lit("all").alias("name"), "value"
    )
    return unknown.unionByName(per_label).unionByName(stable)
