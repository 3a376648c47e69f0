"""Peak, gate, annotation and direction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagledger.functions.numeric import position_score, r6, scope_end, timeline_duration, timeline_origin
from lagledger.operators import annotations as an
from lagledger.operators import epochs as ep
from lagledger.operators import ranking as rk
from lagledger.operators import release as rl
from lagledger.operators import sequence as seq
from lagledger.operators.nearest import nearest_join, window_join
from lagledger.operators.rules import reasons
from lagledger.plans.catalogue import Catalogue
from lagledger.plans.frames import (
    AFTER, BEFORE, EDGES_SQL, EDGE, FRAMES_SQL, LIMITS, PERIOD, QUALITY_SQL, WINDOW_SQL, edge_rows, frames, geometry,
)
from lagledger.plans.standins import (
    CLICK_SQL, CLIPS_SQL, DAILY, DAY_US, E_SQL, GROUP_SQL, HOUR_US, VIEW_SQL, WEEK_US, Slicing, clips, group_of, stream,
)
from lagledger.plans.synchrony import LEDGER_SQL, MARGIN_MS, lag_ledger
from lagledger.session import cut_lineage

cat = Catalogue()
K = ["user_id"]
ORDERED = "PARTITION BY user_id ORDER BY t, event_id"


@cat.query(
    "w13_local_maxima",
    f"""WITH e AS ({E_SQL}), n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM e WINDOW w AS ({ORDERED}))
SELECT event_id FROM n WHERE value >= p AND value >= q AND value >= 30""",
)
def maxima(spark, folder):
    e = stream(spark, folder).select("user_id", "event_id", "t", "value")
    return rl.local_maxima(e, K, "t", "value", DAILY, ties=["event_id"], gates=F.col("value") >= 30).select("event_id")


FOLD = f"""p AS (SELECT user_id, list({{'score': value, 't': t, 'id': event_id}} ORDER BY value DESC, t) AS p FROM e GROUP BY 1)"""


@cat.query(
    "w14_min_separation",
    f"""WITH e AS ({E_SQL}), {FOLD},
r AS (SELECT user_id, list_reduce(list_prepend([p[1]][1:0], list_transform(p, lambda z: [z])), lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y.t - x[1].t) < {12 * HOUR_US})) = 0 THEN list_concat(a, x) ELSE a END) AS kept FROM p)
SELECT user_id, u.id AS event_id FROM (SELECT user_id, unnest(kept) AS u FROM r)""",
)
def separated(spark, folder):
    e = stream(spark, folder).select("user_id", "event_id", "t", "value")
    return rl.min_separation(e, K, "t", "value", "event_id", 12 * HOUR_US, DAILY).select("user_id", "event_id")


@cat.query(
    "w15_cluster_events",
    f"""WITH e AS ({E_SQL}), {FOLD},
r AS (SELECT user_id, p, list_reduce(list_prepend([p[1]][1:0], list_transform(p, lambda z: [z])), lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y.t - x[1].t) <= {12 * HOUR_US})) = 0 THEN list_concat(a, x) ELSE a END) AS leaders FROM p)
SELECT user_id, q.t AS t, list_filter(leaders, lambda y: abs(y.t - q.t) <= {12 * HOUR_US})[1].t AS leader_t, list_filter(leaders, lambda y: abs(y.t - q.t) <= {12 * HOUR_US})[1].score AS leader_score FROM (SELECT user_id, leaders, unnest(p) AS q FROM r)""",
)
def clustered(spark, folder):
    e = stream(spark, folder).select("user_id", "event_id", "t", "value")
    return rl.cluster_events(e, K, "t", "value", 12 * HOUR_US, DAILY)


@cat.query(
    "w16_robust_z",
    f"""WITH e AS ({E_SQL}), m AS (SELECT user_id, median(value) AS med FROM e GROUP BY 1), d AS (SELECT user_id, any_value(med) AS med, median(abs(value - med)) AS mad FROM e JOIN m USING (user_id) GROUP BY 1)
SELECT event_id, round(least(5, greatest(-3, (value - med) / greatest(1.4826 * mad, 1e-5))), 6) AS z FROM e JOIN d USING (user_id)""",
)
def robust(spark, folder):
    e = stream(spark, folder).select("user_id", "event_id", "value")
    return rl.robust_z(e, K, "value").select("event_id", r6("z").alias("z"))


@cat.query(
    "w17_offset_medians",
    f"""WITH e AS ({E_SQL}), a AS (SELECT x.event_id, median(y.value) FILTER (y.t <= x.t - {8 * HOUR_US}) AS pre, median(y.value) FILTER (y.t >= x.t + {4 * HOUR_US}) AS post
 FROM e x LEFT JOIN e y ON y.user_id = x.user_id AND (y.t BETWEEN x.t - {35 * HOUR_US} AND x.t - {8 * HOUR_US} OR y.t BETWEEN x.t + {4 * HOUR_US} AND x.t + {16 * HOUR_US}) GROUP BY 1)
SELECT event_id, round(post - pre, 6) AS rise FROM a""",
)
def rises(spark, folder):
    e = stream(spark, folder).select("user_id", "event_id", "t", "value")
    out = rl.offset_rise(e, K, "t", "value", DAILY, pre=(-35 * HOUR_US, -8 * HOUR_US), post=(4 * HOUR_US, 16 * HOUR_US))
    return out.select("event_id", r6("rise").alias("rise"))


@cat.query(
    "w17_value_at_offset",
    f"""WITH c AS ({CLICK_SQL}), q AS (SELECT user_id, event_id, t + {6 * HOUR_US} AS t FROM c), a AS (SELECT q.*, c.t AS ta, c.value AS va FROM q ASOF LEFT JOIN c ON q.user_id = c.user_id AND q.t >= c.t),
b AS (SELECT a.*, c.t AS tb, c.value AS vb FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.t <= c.t)
SELECT event_id, round(coalesce(va + (vb - va) * CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END, va, vb), 6) AS later FROM b""",
)
def interpolated(spark, folder):
    c = stream(spark, folder, "click").select("user_id", "event_id", "t", "value")
    return rl.value_at(c, K, "t", "value", 6 * HOUR_US, DAILY, tie="event_id", name="later").select("event_id", r6("later").alias("later"))


@cat.query(
    "w17b_continuity",
    f"""WITH v AS ({CLIPS_SQL}) SELECT vec_id, list_min(samples[20:40]) >= samples[10] + 0.01 AS above FROM v""",
)
def continuity(spark, folder):
    # Level between two peaks against the level before the first, on one array.
    s = F.col("samples")
    return clips(spark, folder).select("vec_id", (F.array_min(F.slice(s, 20, 21)) >= s[9] + 0.01).alias("above"))


SIGMA = 1.3
WEIGHT = f"exp(-0.5 * (o / {SIGMA}) ** 2)"


@cat.query(
    "w18_gaussian_smooth",
    f"""WITH v AS ({CLIPS_SQL}), s AS (SELECT vec_id, samples, unnest(range(64)) AS i FROM v), k AS (SELECT o, {WEIGHT} / sum({WEIGHT}) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS o))
SELECT vec_id, i::INTEGER AS i, round(sum(w * samples[least(63, greatest(0, i + o)) + 1]), 6) AS smooth FROM s CROSS JOIN k GROUP BY ALL""",
)
def gaussian(spark, folder):
    s = clips(spark, folder).select("vec_id", F.posexplode("samples").alias("i", "x"))
    return rl.gaussian_smooth(s, ["vec_id"], "i", "x", SIGMA).select("vec_id", "i", r6("smooth").alias("smooth"))


@cat.query(
    "f20_position_score",
    f"WITH e AS ({E_SQL}) SELECT event_id, round(value / 50 - 0.80 * abs((event_id % 300 - 45) / 150), 6) AS score FROM e",
)
def position(spark, folder):
    return stream(spark, folder).select("event_id", r6(position_score(F.col("value") / 50, (F.col("event_id") % 300).cast("double"))).alias("score"))


@cat.query(
    "j8_assign_occurrences",
    f"""WITH v AS ({CLIPS_SQL}), a AS (SELECT vec_id, list_sort(samples[1:3]) AS an, list_sort(samples[10:15]) AS ld FROM v),
n AS (SELECT vec_id, ld, list_transform(an, lambda x: list_position(list_transform(ld, lambda y: abs(y - x)), list_min(list_transform(ld, lambda y: abs(y - x))))) AS nr FROM a)
SELECT vec_id, CASE WHEN len(list_distinct(nr)) = 3 AND nr = list_sort(nr) AND ld[nr[2]] - ld[nr[1]] > 0.01 AND ld[nr[3]] - ld[nr[2]] > 0.01 THEN array_to_string(list_transform(nr, lambda x: x - 1), ',') END AS assignment,
 CASE WHEN NOT (len(list_distinct(nr)) = 3 AND nr = list_sort(nr) AND ld[nr[2]] - ld[nr[1]] > 0.01 AND ld[nr[3]] - ld[nr[2]] > 0.01) THEN 'unresolved_bilabial_occurrences_in_word' END AS reason FROM n""",
)
def assigned(spark, folder):
    v = clips(spark, folder).select("vec_id", F.array_sort(F.slice("samples", 1, 3)).alias("a"), F.array_sort(F.slice("samples", 10, 6)).alias("l"))
    out = v.select("vec_id", rl.assign_occurrences(F.col("a"), F.col("l"), 0.01).alias("x"))
    return out.select("vec_id", F.when(F.col("x.assignment").isNotNull(), F.array_join("x.assignment", ",")).alias("assignment"), F.col("x.reason").alias("reason"))


# Candidates: every event, with gate inputs derived from its value and id.
CAND_SQL = f"""e AS ({E_SQL}), c AS (SELECT event_id, user_id, t, 0.8 + (event_id % 3) * 0.1::DOUBLE AS local_coverage, value / 25 AS spectral_flux_z, (event_id % 12)::DOUBLE AS high_frequency_rise_db,
 value / 4 AS energy_rise_db, (event_id % 17)::DOUBLE AS energy_slope_12ms_db, value / 10 AS score, (event_id % 300 - 100)::DOUBLE AS distance_from_anchor_ms, CASE WHEN event_type = 'click' THEN 'p' ELSE 'b' END AS phone FROM e)"""


def candidates(spark, folder):
    e, v = F.col("event_id"), F.col("value")
    return stream(spark, folder).select(
        "event_id", "user_id", "t", (F.lit(0.8) + (e % 3) * F.lit(0.1)).alias("local_coverage"), (v / 25).alias("spectral_flux_z"),
        (e % 12).cast("double").alias("high_frequency_rise_db"), (v / 4).alias("energy_rise_db"), (e % 17).cast("double").alias("energy_slope_12ms_db"),
        (v / 10).alias("score"), (e % 300 - 100).cast("double").alias("distance_from_anchor_ms"),
        F.when(F.col("event_type") == "click", "p").otherwise("b").alias("phone"),
    )


@cat.query(
    "p4_permissive_gate",
    f"""WITH {CAND_SQL} SELECT event_id, concat_ws(',', CASE WHEN local_coverage < 0.90 THEN 'incomplete_audio_coverage' END, CASE WHEN spectral_flux_z < 1.5 THEN 'weak_spectral_burst' END,
 CASE WHEN high_frequency_rise_db < 1.5 THEN 'weak_high_frequency_release' END, CASE WHEN energy_rise_db < CASE WHEN phone = 'p' THEN 2.5 ELSE 0.5 END THEN 'no_clear_post_release_energy_rise' END) AS reasons FROM c""",
)
def permissive(spark, folder):
    gate = rl.permissive_gate(rl.ReleaseConfig(), F.col("phone"))
    return candidates(spark, folder).select("event_id", F.concat_ws(",", gate(F.col)).alias("reasons"))


@cat.query(
    "p5_conservative_gate",
    f"""WITH {CAND_SQL} SELECT event_id, concat_ws(',', CASE WHEN local_coverage < 0.90 THEN 'incomplete_audio_coverage' END, CASE WHEN energy_rise_db < 10 THEN 'conservative_energy_rise_below_threshold' END,
 CASE WHEN energy_slope_12ms_db < 10 THEN 'conservative_12ms_energy_slope_below_threshold' END, CASE WHEN high_frequency_rise_db < 8 THEN 'conservative_high_frequency_rise_below_threshold' END,
 CASE WHEN score < 5.5 THEN 'conservative_score_below_threshold' END, CASE WHEN distance_from_anchor_ms NOT BETWEEN -60 AND 160 THEN 'acoustic_candidate_outside_conservative_anchor_gate' END) AS reasons FROM c""",
)
def conservative(spark, folder):
    gate = rl.conservative_gate(rl.ReleaseConfig())
    return candidates(spark, folder).select("event_id", F.concat_ws(",", gate(F.col)).alias("reasons"))


@cat.query(
    "t1_top_candidates",
    f"""WITH {CAND_SQL}, r AS (SELECT *, phone = 'p' AS target, t // {DAY_US} AS d FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY target DESC, score DESC, t) AS rn, event_id = min(event_id) OVER (PARTITION BY user_id, d) AS sel FROM r),
x AS (SELECT *, bool_or(sel AND rn > 2) OVER (PARTITION BY user_id, d) AS cut FROM s) SELECT event_id, rn::INTEGER AS display_rank FROM x WHERE rn <= CASE WHEN cut THEN 1 ELSE 2 END OR sel""",
)
def top(spark, folder):
    c = candidates(spark, folder).withColumn("ev", F.concat_ws("-", "user_id", F.floor(F.col("t") / DAY_US)))
    first = c.groupBy("ev").agg(F.min("event_id").alias("_first"))
    c = c.join(first, "ev").withColumn("sel", F.col("event_id") == F.col("_first"))
    out = rk.top_candidates(c, "ev", 2, target=F.col("phone") == "p", score="score", time="t", selected=F.col("sel"))
    return out.select("event_id", "display_rank")


@cat.query(
    "t9_earliest_equivalent",
    f"""WITH {CAND_SQL}, r AS (SELECT *, t // {DAY_US} AS d FROM c), tp AS (SELECT user_id, d, event_id AS top_id, score AS ts, spectral_flux_z AS tf FROM r QUALIFY row_number() OVER (PARTITION BY user_id, d ORDER BY score DESC, t) = 1),
f AS (SELECT r.user_id, r.d, arg_min(event_id, t) AS e FROM r JOIN tp USING (user_id, d) WHERE score >= ts - 1.5 AND spectral_flux_z >= tf * 0 + tf AND high_frequency_rise_db >= 3 GROUP BY ALL)
SELECT user_id, d, coalesce(e, top_id) AS event_id FROM tp LEFT JOIN f USING (user_id, d)""",
)
def earliest(spark, folder):
    c = candidates(spark, folder).withColumn("d", F.floor(F.col("t") / DAY_US))
    m = c.select(F.struct("user_id", "d").alias("ev"), "event_id", F.col("t").alias("time_s"), "score", "spectral_flux_z", "high_frequency_rise_db")
    out = rk.earliest_equivalent(m, "ev", gates=F.col("high_frequency_rise_db") >= 3)
    return out.select("ev.user_id", "ev.d", "event_id")


# Annotations: clicks with labels, a review window and covered spans derived from the row.
ANN = f"""a AS (SELECT event_id, t / 1e6 AS anchor, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN t / 1e6 + 999 ELSE t / 1e6 + (event_id % 5) * 0.3::DOUBLE END AS time_s,
 CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'other' ELSE 'p' END AS label, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'p' END AS nested_label, t / 1e6 - 1 AS w0, t / 1e6 + 2 AS w1 FROM ({CLICK_SQL}))"""


def annotated(spark, folder):
    e, a = F.col("event_id"), F.col("t") / 1e6
    span = lambda x, y: F.struct(x.alias("start_s"), y.alias("end_s"))
    c = stream(spark, folder, "click")
    return c.select(
        "event_id", "t", "user_id", "value", a.alias("anchor_s"),
        F.when(e % 7 == 0, None).when(e % 7 == 1, a + 999).otherwise(a + (e % 5) * F.lit(0.3)).alias("time_s"),
        F.when(e % 4 == 0, None).when(e % 4 == 1, "other").otherwise("p").alias("label"), F.when(e % 3 != 0, "p").alias("nested_label"),
        (a - 1).alias("window_start_s"), (a + 2).alias("window_end_s"), F.array(span(a - 1, a + 0.5), span(a + 0.8, a + 2)).alias("covered_intervals"),
    )


@cat.query(
    "p11_annotation_guard",
    f"""WITH {ANN} SELECT event_id, concat_ws(',', CASE WHEN coalesce(label <> 'p', false) THEN 'explicit_non_target_label' END, CASE WHEN time_s IS NULL THEN 'time_not_finite' END,
 CASE WHEN NOT (time_s >= w0 AND time_s < w1) THEN 'time_outside_review_window' END, CASE WHEN time_s IS NOT NULL AND NOT ((round(time_s, 9) >= round(w0, 9) AND round(time_s, 9) < round(anchor + 0.5, 9)) OR (round(time_s, 9) >= round(anchor + 0.8, 9) AND round(time_s, 9) < round(w1, 9))) THEN 'time_not_covered' END) AS reasons,
 CASE WHEN label IS NULL AND nested_label IS NULL THEN 'legacy_unspecified' ELSE 'explicit' END AS label_state FROM a""",
)
def guard(spark, folder):
    return an.annotation_guard(annotated(spark, folder), "p").select("event_id", F.concat_ws(",", "guard_reasons").alias("reasons"), "label_state")


@cat.query(
    "p17_audio_scope",
    f"""WITH c AS ({CLICK_SQL}) SELECT event_id, event_id % 7 > 1 AND event_id % 4 <> 1 AND (event_id % 5) * 3 NOT IN (6) AND (event_id % 5) <> 2 AND t / 1e6 < 1705320000 AND t / 1e6 + (event_id % 5) * 0.3::DOUBLE < 1705320000 AS audio_in_scope FROM c""",
)
def scope(spark, folder):
    a = an.annotation_guard(annotated(spark, folder), "p").withColumn("status", F.lit("measurable")).withColumn("token_s", F.col("anchor_s"))
    return an.audio_scope(a, 1705320000.0).select("event_id", "audio_in_scope")


@cat.query(
    "p18_status_consistency",
    f"""WITH {ANN} SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 AND time_s IS NULL THEN 'measurable_without_time' END,
 CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 1 AND time_s IS NOT NULL THEN 'unmeasurable_with_time' END, CASE WHEN label IS DISTINCT FROM 'p' THEN 'class_mismatch' END, CASE WHEN event_id % 13 = 0 THEN 'unknown_group' END) AS reasons
FROM a WHERE event_id % 11 <> 0 UNION ALL SELECT event_id, concat_ws(',', 'status_missing', CASE WHEN time_s IS NOT NULL THEN 'unmeasurable_with_time' END, CASE WHEN label IS DISTINCT FROM 'p' THEN 'class_mismatch' END, CASE WHEN event_id % 13 = 0 THEN 'unknown_group' END) FROM a WHERE event_id % 11 = 0""",
)
def consistency(spark, folder):
    e = F.col("event_id")
    rows = annotated(spark, folder).select(
        "event_id", "time_s", F.when(e % 11 == 0, " ").when(e % 2 == 0, "measurable").otherwise("unmeasurable").alias("status"), F.col("label").alias("phoneme_class"),
        F.lit("p").alias("selected_class"), F.col("user_id").cast("string").alias("speaker"), F.when(e % 13 == 0, "guest").otherwise(group_of()).alias("grp"), F.lit("x").alias("epoch_id"),
    )
    return an.status_consistency(rows).select("event_id", F.concat_ws(",", "status_reasons").alias("reasons"))


REVIEW_SQL = f"""WITH c AS ({CLICK_SQL}), r AS (SELECT *, t / 1e6 AS an, CASE event_id % 4 WHEN 0 THEN ' Measurable' WHEN 1 THEN 'measurable' WHEN 2 THEN 'unmeasurable' ELSE 'ambiguous' END AS status,
 CASE event_id % 5 WHEN 0 THEN 'P ' WHEN 1 THEN 'b' WHEN 2 THEN 'target' ELSE 'p' END AS realization, CASE WHEN event_id % 6 < 4 THEN event_id % 6 END AS pick, CASE WHEN event_id % 7 < 3 THEN event_id % 7 * 15.0 END AS rel FROM c),
q AS (SELECT *, lower(trim(status)) = 'measurable' AS m, an + [0, 0.015, 0.6][pick] AS cand FROM r), k AS (SELECT *, CASE WHEN m THEN CASE WHEN pick IS NULL THEN an + rel / 1000 ELSE cand END END AS z FROM q)
SELECT event_id, concat_ws(',', CASE WHEN status = 'ambiguous' THEN 'invalid_status' END, CASE WHEN event_id % 11 = 0 THEN 'invalid_confidence' END, CASE WHEN realization = 'target' THEN 'invalid_realization' END,
 CASE WHEN event_id % 8 = 0 THEN 'reason_missing' END, CASE WHEN event_id % 9 = 0 THEN 'anchor_differs_from_source' END, CASE WHEN event_id % 10 = 0 THEN 'invalid_review_window' END,
 CASE WHEN event_id % 13 = 0 THEN 'candidate_rank_not_its_place' END, CASE WHEN event_id % 10 = 0 THEN 'candidate_outside_review_window' END, CASE WHEN event_id % 10 <> 0 THEN 'candidate_not_covered' END,
 CASE WHEN event_id % 14 = 0 THEN 'candidate_relative_time_differs' END, CASE WHEN m AND lower(trim(realization)) <> 'p' THEN 'measurable_requires_target' END, CASE WHEN m AND pick IS NULL AND rel IS NULL THEN 'no_time_chosen' END,
 CASE WHEN m AND pick = 0 THEN 'rank_out_of_range' END, CASE WHEN m AND pick > 0 AND abs(cand - (an + rel / 1000)) > 0.020 THEN 'rank_and_time_disagree' END, CASE WHEN m AND event_id % 10 = 0 AND z IS NOT NULL THEN 'time_outside_review_window' END,
 CASE WHEN m AND event_id % 10 <> 0 AND z > an + 0.55 THEN 'time_not_covered' END, CASE WHEN status = 'unmeasurable' AND (pick IS NOT NULL OR rel IS NOT NULL) THEN 'unmeasurable_with_time' END) AS reasons FROM k"""


@cat.query("p19_review_row_valid", REVIEW_SQL)
def reviewed(spark, folder):
    e, a = F.col("event_id"), F.col("anchor_s")
    cand = lambda r, ms, off: F.struct(r.alias("rank"), (a + ms / 1000.0).alias("time_s"), (F.lit(float(ms)) + off).alias("relative_ms"))
    none = F.lit(0.0)
    rows = annotated(spark, folder).withColumns(
        {
            "status": F.when(e % 4 == 0, " Measurable").when(e % 4 == 1, "measurable").when(e % 4 == 2, "unmeasurable").otherwise("ambiguous"),
            "confidence": F.when(e % 11 == 0, "sure").otherwise("High"), "realization": F.when(e % 5 == 0, "P ").when(e % 5 == 1, "b").when(e % 5 == 2, "target").otherwise("p"),
            "reason": F.when(e % 8 == 0, " ").otherwise("clear"), "selected_rank": F.when(e % 6 < 4, e % 6).cast("int"), "relative_ms": F.when(e % 7 < 3, (e % 7) * 15.0),
            "source_anchor_s": a + F.when(e % 9 == 0, 0.5).otherwise(0.0), "target_class": F.lit("/P/"),
            # an inverted window in every tenth row, with spans that still lie in order inside
            "window_end_s": F.when(e % 10 == 0, a - 0.9).otherwise(a + 2),
            "covered_intervals": F.when(e % 10 == 0, F.array(F.struct((a - 1).alias("start_s"), (a - 0.95).alias("end_s")))).otherwise(F.col("covered_intervals")),
            "candidates": F.array(
                cand(F.when(e % 13 == 0, 7).otherwise(1), 0, none), cand(F.lit(None).cast("int"), 15, F.when(e % 14 == 0, 1.0).otherwise(0.0)), cand(F.lit(3), 600, none)
            ),
        }
    )
    return an.review_row_valid(rows).select("event_id", F.concat_ws(",", "review_reasons").alias("reasons"))


@cat.query(
    "p20_auto_accept",
    f"WITH {CAND_SQL} SELECT event_id, local_coverage >= 0.9 AND score / 10 >= 0.80 AS auto_accepted, local_coverage >= 0.9 AND score / 10 >= 0.80 AND event_id % 2 = 0 AS final_measurable FROM c",
)
def accepted(spark, folder):
    rows = candidates(spark, folder).select(
        "event_id", (F.col("local_coverage") >= 0.9).alias("audio_measurable"), (F.col("score") / 10).alias("asr_probability"), (F.col("event_id") % 2 == 0).alias("visual_measurable")
    )
    return an.auto_accept(rows).select("event_id", "auto_accepted", "final_measurable")


@cat.query(
    "p21_scope_end",
    f"""WITH e AS ({E_SQL}), s AS (SELECT event_id, value, coalesce(CASE event_id % 3 WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE END, value) AS stop FROM e)
SELECT event_id, CASE WHEN isfinite(stop) AND stop > 0 AND stop <= value + 1e-6::DOUBLE THEN least(stop, value) END AS scope_end FROM s""",
)
def scope_ends(spark, folder):
    m = F.col("event_id") % 3
    asked = F.when(m == 1, F.lit(20.0)).when(m == 2, F.lit(-1.0))
    return stream(spark, folder).select("event_id", scope_end("value", asked, strict=False).alias("scope_end"))


@cat.query(
    "p22_normalize_annotation",
    f"""WITH e AS ({E_SQL}) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'flat' ELSE 'nested' END AS status, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS time_s,
 CASE WHEN event_id % 6 = 0 THEN 'class_differs_from_selection' ELSE '' END AS reasons FROM e""",
)
def normalized(spark, folder):
    e = F.col("event_id")
    rows = stream(spark, folder).select(
        "event_id", F.struct(F.lit("p").alias("phoneme_class")).alias("selection"), F.lit("nested").alias("annotation_status"), (F.col("value") + 1).alias("audio_release_time_s"),
        F.when(e % 2 == 0, "flat").alias("status"), F.when(e % 2 == 0, F.col("value")).alias("selected_release_time_s"), F.when(e % 6 == 0, "b").alias("phoneme_class"),
    )
    return an.normalize_annotation(rows).select("event_id", F.col("norm_status").alias("status"), F.col("norm_time_s").alias("time_s"), F.concat_ws(",", "norm_reasons").alias("reasons"))


@cat.query(
    "p3_media_profile_gate",
    f"""WITH e AS ({E_SQL}) SELECT event_id, concat_ws(',', CASE WHEN event_id % 4 = 0 THEN 'width_differs' END, CASE WHEN event_id % 5 = 0 THEN 'codec_differs' END, CASE WHEN NOT (abs(23.98 + (event_id % 6) * 0.01::DOUBLE - 24) <= 0.01) THEN 'average_fps_differs' END) AS reasons FROM e""",
)
def profile(spark, folder):
    e = F.col("event_id")
    rows = stream(spark, folder).select(
        "event_id", F.when(e % 4 == 0, 1280).otherwise(1920).alias("width"), F.when(e % 5 != 0, "h264").alias("codec"), (F.lit(23.98) + (e % 6) * F.lit(0.01)).alias("average_fps")
    )
    return an.profile_gate(rows, {"width": 1920, "codec": "h264"}, 24.0).select("event_id", F.concat_ws(",", "profile_reasons").alias("reasons"))


@cat.query(
    "f23_timeline_origin",
    f"""WITH e AS ({E_SQL}), o AS (SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN least(value, 40.0) END, 0.0) AS origin, value FROM e)
SELECT event_id, origin, round(CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value * 3 - origin END, 6) AS duration FROM o""",
)
def origin(spark, folder):
    m, v = F.col("event_id") % 3, F.col("value")
    starts = F.array(F.when(m == 1, v), F.when(m == 1, F.lit(40.0)))
    rows = stream(spark, folder).withColumn("origin", timeline_origin(F.when(m == 0, v), starts))
    d = timeline_duration(F.when(F.col("event_id") % 2 == 0, v * 2), F.array(v * 3, v), "origin")
    return rows.select("event_id", "origin", r6(d).alias("duration"))


# Mouth shape of the frame nearest to each click.
SHAPE_SQL = f"""{QUALITY_SQL}, c AS ({CLICK_SQL}), nr AS (SELECT c.event_id AS audio_id, c.user_id, c.t AS audio_t, c.value, f.* EXCLUDE (user_id, event_type), row_number() OVER (PARTITION BY c.event_id ORDER BY abs(f.t - c.t), f.t, f.event_id) AS rn FROM c JOIN f USING (user_id)),
sv AS (SELECT *, face_detected AND mouth_width_px >= 80 AND aperture_spread <= 0.020 AND face_quality >= 0.25 AND abs(t - audio_t) / {PERIOD}.0 <= 0.75 AS ok FROM nr WHERE rn = 1),
sh AS (SELECT *, CASE WHEN NOT ok THEN 'unavailable' WHEN median_aperture <= 0.015 AND maximum_aperture <= 0.025 THEN 'closed/contact' WHEN median_aperture >= 0.035 THEN 'open' ELSE 'transition' END AS shape FROM sv)"""


def shapes(spark, folder):
    f = frames(spark, folder)
    c = stream(spark, folder, "click").select("user_id", F.col("event_id").alias("audio_id"), "t", "value")
    near = nearest_join(c, f, ["user_id"], "t", DAILY, tie="event_id")
    names = ["median_aperture", "maximum_aperture", "aperture_spread", "mouth_width_px", "face_quality", "face_detected"]
    rows = near.select("audio_id", "user_id", "t", "value", ((F.col("match.t") - F.col("t")) / PERIOD).alias("error"), F.lit(1.0).alias("period"), *[F.col(f"match.{n}").alias(n) for n in names])
    return an.shape_valid(rows, LIMITS, "period", "error")


@cat.query("p16_mouth_shape_valid", f"WITH {SHAPE_SQL} SELECT audio_id, shape, ok AS shape_valid FROM sh")
def shape_rows(spark, folder):
    return shapes(spark, folder).select("audio_id", "shape", "shape_valid")


@cat.query(
    "p10_direction_consistency",
    f"""WITH {SHAPE_SQL}, l AS (SELECT audio_id, shape, CASE WHEN value < 100 THEN (t - audio_t) / 3.6e9 END AS lag FROM sh)
SELECT CASE WHEN lag IS NULL THEN 'lag_unavailable' WHEN shape = 'unavailable' THEN 'shape_unavailable' WHEN abs(lag) <= 1 THEN 'consistent_within_one_frame' WHEN lag > 0 AND shape <> 'open' THEN 'consistent_video_lags'
 WHEN lag < 0 AND shape = 'open' THEN 'consistent_video_leads' WHEN lag > 0 THEN 'inconsistent_video_lags' ELSE 'inconsistent_video_leads' END AS state, count(*) AS events FROM l GROUP BY 1""",
)
def consistent(spark, folder):
    rows = shapes(spark, folder).withColumn("lag", F.when(F.col("value") < 100, F.col("error") * (PERIOD / 3.6e9)))
    return rows.groupBy(an.direction_consistency("lag", "shape", 1.0).alias("state")).agg(F.count(F.lit(1)).alias("events"))


@cat.query(
    "p10_direction_counts",
    f"""WITH {SHAPE_SQL}, l AS (SELECT user_id, coalesce(ok, false) AS ok, shape, CASE WHEN value < 100 THEN (t - audio_t) / 3.6e9 END AS lag FROM sh),
d AS (SELECT user_id, ok, ok AND lag IS NOT NULL AS known, ok AND abs(lag) <= 1 AS w, ok AND lag > 1 AS p, ok AND lag < -1 AS m, shape = 'open' AS o FROM l)
SELECT user_id, count(*) FILTER (ok) AS burst_shape_eligible_event_count, count(*) FILTER (known) AS lag_available_count, count(*) FILTER (ok AND NOT known) AS lag_unavailable_count, count(*) FILTER (w) AS within_one_frame_count,
 count(*) FILTER (p) AS positive_beyond_one_frame_count, count(*) FILTER (p AND NOT o) AS positive_consistent_count, count(*) FILTER (p AND o) AS positive_inconsistent_count,
 count(*) FILTER (m) AS negative_beyond_one_frame_count, count(*) FILTER (m AND o) AS negative_consistent_count, count(*) FILTER (m AND NOT o) AS negative_inconsistent_count,
 count(*) FILTER (w OR (p AND NOT o) OR (m AND o)) AS consistent_count, count(*) FILTER ((p AND o) OR (m AND NOT o)) AS inconsistent_count FROM d GROUP BY 1""",
)
def direction_counters(spark, folder):
    rows = shapes(spark, folder).withColumn("lag", F.when(F.col("value") < 100, F.col("error") * (PERIOD / 3.6e9)))
    return an.direction_counts(rows, ["user_id"], "lag", "shape", 1.0, "shape_valid")


# Clicks stand for acoustic estimates, the nearest view for the visual one; some were not measured, some have no visual row.
RECORD_SQL = f"""c AS ({CLICK_SQL}), v AS ({VIEW_SQL}),
n AS (SELECT c.event_id, v.t AS vt, v.event_id AS vid, v.value AS vv, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.t - c.t), v.t, v.event_id) AS rn FROM c JOIN v USING (user_id)),
r AS (SELECT c.*, vt, vid, vv, c.event_id % 5 <> 0 AS seen FROM c LEFT JOIN n ON n.event_id = c.event_id AND rn = 1),
m AS (SELECT *, value >= 10 AND seen AND vt IS NOT NULL AND coalesce(vid % 7 <> 0, false) AS ok FROM r)"""


@cat.query(
    "d12_combined_record",
    f"""WITH {RECORD_SQL} SELECT event_id AS audio_id, ok AS measurable, CASE WHEN ok THEN round((vt - t) / 1000.0, 3) END AS lag_ms,
 CASE WHEN ok THEN round(sqrt(power((1 + event_id % 4) / 2.0, 2) + power(CASE WHEN vid % 3 = 0 THEN 0 ELSE vv END, 2)), 6) END AS uncertainty_ms,
 concat_ws(',', CASE WHEN value < 10 THEN 'weak' END, CASE WHEN user_id % 2 = 0 THEN 'even' END, CASE WHEN seen AND vt IS NULL THEN 'no_view' END, CASE WHEN seen AND vid % 7 = 0 THEN 'blurred' END,
  CASE WHEN seen AND user_id % 4 = 1 THEN 'odd' END) AS reasons FROM m""",
)
def combined_record(spark, folder):
    c = stream(spark, folder, "click").select("user_id", F.col("event_id").alias("audio_id"), "t", "value")
    v = stream(spark, folder, "view").select("user_id", "t", F.col("event_id").alias("view_id"), "value")
    near = cut_lineage(nearest_join(c, v, K, "t", DAILY, tie="view_id"))
    user, seen = F.col("user_id"), F.col("match.view_id")
    acoustic = near.select(
        "audio_id", (F.col("value") >= 10).alias("measurable"), F.when(F.col("value") >= 5, F.col("t") / 1e6).alias("release_time_s"),
        (F.col("audio_id") % 4 + 1).cast("double").alias("time_resolution_ms"), reasons((F.col("value") < 10, "weak"), (user % 2 == 0, "even")).alias("exclusion_reasons"),
    )
    visual = near.filter("audio_id % 5 != 0").select(
        "audio_id", F.coalesce(seen % 7 != 0, F.lit(False)).alias("measurable"), (F.col("match.t") / 1e6).alias("release_time"),
        F.when(seen % 3 != 0, F.col("match.value") / 1000.0).alias("uncertainty"),
        reasons((user % 2 == 0, "even"), (seen.isNull(), "no_view"), (seen % 7 == 0, "blurred"), (user % 4 == 1, "odd")).alias("exclusion_reasons"),
    )
    out = rl.combine(acoustic, visual, "audio_id")
    return out.select("audio_id", "measurable", F.round("release_lag_ms", 3).alias("lag_ms"), r6("lag_uncertainty_ms").alias("uncertainty_ms"), F.concat_ws(",", "exclusion_reasons").alias("reasons"))


@cat.query(
    "a8_burst_shape_rates",
    f"""WITH {SHAPE_SQL} SELECT user_id AS speaker, count(*) AS shape_count, count(*) FILTER (shape = 'closed/contact') AS closed_count, count(*) FILTER (shape = 'transition') AS transition_count, count(*) FILTER (shape = 'open') AS open_count,
 round(avg((shape = 'open')::INT), 6) AS open_rate, round(median(median_aperture), 6) AS median_aperture FROM sh WHERE ok AND value >= 10 GROUP BY 1""",
)
def shape_table(spark, folder):
    rows = shapes(spark, folder).select(
        F.col("user_id").alias("speaker"), (F.col("value") >= 10).alias("audio_measurable"), "shape_valid", "shape", F.col("median_aperture").alias("aperture")
    )
    s = ep.shape_rates(rows, ["speaker"])
    return s.select("speaker", "shape_count", "closed_count", "transition_count", "open_count", r6("open_rate").alias("open_rate"), r6("median_aperture").alias("median_aperture"))


# Direction analysis: closure geometry plus the edge nearest to each click.
DIR_SQL = f"""{EDGES_SQL}, {WINDOW_SQL}, pk AS (SELECT audio_id, edge_lag, count(*) OVER (PARTITION BY audio_id) AS n, row_number() OVER (PARTITION BY audio_id ORDER BY abs(edge_lag), edge_time) AS rn FROM edges),
dr AS (SELECT g.audio_id, c.user_id, c.t, g.face_valid, CASE WHEN NOT g.face_valid THEN 'unavailable' WHEN contact_count = 0 THEN 'no_visible_contact' WHEN contact_count = 1 THEN 'weak_contact' ELSE 'strong_contact' END AS closure,
 g.face_valid AND coalesce(earliest > {PERIOD}, false) AS post_only, CASE WHEN g.face_valid THEN pk.edge_lag END AS lag, coalesce(CASE WHEN g.face_valid THEN pk.n END, 0) AS edges
 FROM geo g JOIN c ON c.event_id = g.audio_id LEFT JOIN pk ON pk.audio_id = g.audio_id AND pk.rn = 1)"""
HALF_DAY_MS = 12 * 3_600_000.0


def directions(spark, folder):
    g = geometry(spark, folder)
    edge = seq.nearest_edge(edge_rows(spark, folder), "audio_id").select("audio_id", F.col("edge.edge_lag").alias("lag"), "edge_count")
    who = stream(spark, folder, "click").select(F.col("event_id").alias("audio_id"), "user_id", "t")
    valid = F.col("face_valid")
    return g.join(who, "audio_id").join(edge, "audio_id", "left").select(
        "audio_id", F.col("user_id").alias("speaker"), group_of().alias("grp"), F.floor(F.col("t") / WEEK_US).alias("epoch_id"), "face_valid", "closure",
        (valid & F.coalesce(F.col("earliest_contact") > PERIOD, F.lit(False))).alias("post_audio_only"), F.when(valid, F.col("lag")).alias("edge_lag_ms"),
        F.when(valid, F.coalesce("edge_count", F.lit(0))).otherwise(0).alias("edge_count"),
    )


RATES = f"""count(*) AS event_count, count(*) FILTER (face_valid) AS face_valid_count, count(*) FILTER (closure = 'weak_contact') AS weak_contact_count,
 round(count(*) FILTER (closure = 'no_visible_contact') / nullif(count(*) FILTER (face_valid), 0), 6) AS no_visible_contact_rate,
 round(count(*) FILTER (closure IN ('no_visible_contact', 'weak_contact')) / nullif(count(*) FILTER (face_valid), 0), 6) AS not_strong_contact_rate,
 round(count(*) FILTER (post_only) / nullif(count(*) FILTER (face_valid), 0), 6) AS post_audio_only_contact_rate,
 round(count(*) FILTER (face_valid AND abs(lag) > {HALF_DAY_MS}) / nullif(count(*) FILTER (face_valid), 0), 6) AS far_direction_rate,
 round(count(*) FILTER (face_valid AND lag IS NULL) / nullif(count(*) FILTER (face_valid), 0), 6) AS direction_unavailable_rate, round(median(lag), 3) AS median_edge_lag_ms"""


def rate_columns(t, keys):
    rates = ["no_visible_contact_rate", "not_strong_contact_rate", "post_audio_only_contact_rate", "far_direction_rate", "direction_unavailable_rate"]
    return t.select(
        *keys, "event_count", "face_valid_count", "weak_contact_count", *[r6(r).alias(r) for r in rates], F.round("median_edge_lag_ms", 3).alias("median_edge_lag_ms")
    )


@cat.query("a6_speaker_rates", f"WITH {DIR_SQL} SELECT s.user_id AS speaker, {RATES.replace('count(*) AS event_count', 'count(audio_id) AS event_count')} FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN dr USING (user_id) GROUP BY 1")
def speaker_rates(spark, folder):
    d = cut_lineage(directions(spark, folder))
    everyone = stream(spark, folder).select(F.col("user_id").alias("speaker"))
    return rate_columns(ep.direction_rates(d, ["speaker"], margin_ms=HALF_DAY_MS, everyone=everyone), ["speaker"])


@cat.query("a7_epoch_rates", f"WITH {DIR_SQL} SELECT user_id AS speaker, {GROUP_SQL} AS grp, t // {WEEK_US} AS epoch_id, {RATES} FROM dr WHERE face_valid GROUP BY 1, 2, 3")
def epoch_rates(spark, folder):
    d = cut_lineage(directions(spark, folder).filter("face_valid"))
    keys = ["speaker", "grp", "epoch_id"]
    return rate_columns(ep.direction_rates(d, keys, margin_ms=HALF_DAY_MS), keys)


@cat.query(
    "a9_abs_lag_groups",
    f"""WITH {LEDGER_SQL}, ea AS (SELECT speaker, grp, epoch_id, median(abs(lag_ms)) AS m FROM used GROUP BY ALL), g AS (SELECT grp, count(*) AS epochs, median(m) AS mm FROM ea GROUP BY 1), u AS (SELECT grp, count(*) AS events FROM used GROUP BY 1)
SELECT grp, epochs, events, round(mm, 3) AS median_epoch_abs_ms, round((SELECT max(mm) FILTER (grp = 'candidate') - max(mm) FILTER (grp = 'control') FROM g), 3) AS candidate_minus_control_ms FROM g JOIN u USING (grp)""",
)
def abs_groups(spark, folder):
    used = cut_lineage(lag_ledger(spark, folder).filter("measurable"))
    groups, _ = ep.absolute_lag_descriptives(used)
    return groups.select("grp", "epochs", "events", *[F.round(c, 3).alias(c) for c in ("median_epoch_abs_ms", "candidate_minus_control_ms")])


@cat.query(
    "a9_abs_lag_speakers",
    f"""WITH {LEDGER_SQL}, sp AS (SELECT speaker, median(lag_ms) AS a, median(abs(lag_ms)) AS b FROM used GROUP BY 1)
SELECT speaker, round(any_value(a), 3) AS median_ms, round(median(abs(lag_ms - a)), 3) AS mad_ms, round(any_value(b), 3) AS median_abs_ms, round(median(abs(abs(lag_ms) - b)), 3) AS mad_abs_ms FROM used JOIN sp USING (speaker) GROUP BY 1""",
)
def abs_speakers(spark, folder):
    used = cut_lineage(lag_ledger(spark, folder).filter("measurable"))
    _, speakers = ep.absolute_lag_descriptives(used)
    return speakers.select("speaker", *[F.round(c, 3).alias(c) for c in ("median_ms", "mad_ms", "median_abs_ms", "mad_abs_ms")])


@cat.query("w5_visual_release")
def visual(spark, folder):
    """Visual release in the frames round each click; times in units of half a frame period."""
    f = frames(spark, folder).select("user_id", (F.col("t") / 1e6 / 3600).alias("h"), "median_aperture", "maximum_aperture", "aperture_spread", "mouth_width_px", "face_quality", "face_detected", "repeated_frame")
    c = stream(spark, folder, "click").select("user_id", F.col("event_id").alias("audio_id"), (F.col("t") / 1e6 / 3600).alias("anchor"))
    limits = seq.MouthLimits(
        width_jump=0.9, quality=0.1, confirmations=1, confirm_within=72.0, closure_minimum=1.0, closure_maximum=120.0, search_before=72.0, search_after=72.0, release_gap=72.0, freeze=72.0
    )
    window = window_join(c, f, ["user_id"], "anchor", "h", 120.0, 120.0)
    v = rl.visual_release(window, "audio_id", "h", limits)
    return v.select("audio_id", "measurable", r6("release_time").alias("release_h"), F.concat_ws(",", "exclusion_reasons").alias("reasons"))


def sample_windows(spark, folder):
    """Each clip's 640 samples as one window at a nominal 1 kHz, anchored in its middle."""
    v = clips(spark, folder)
    span = F.lit(None).cast("struct<start_s:double,end_s:double>")
    whole = v.groupBy(F.col("clip_id").cast("string").alias("event_id")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "samples"))), lambda x: x["samples"])).alias("samples")
    )
    loud = F.transform("samples", lambda x, i: x * F.when(i < 300, 0.001).otherwise(1.0))
    return whole.select(
        "event_id", F.lit(0.0).alias("window_start_s"), F.lit(1000).alias("sample_rate"), loud.alias("samples"), F.lit(0.30).alias("anchor_s"),
        span.alias("target_window"), span.alias("previous_window"), span.alias("next_window"),
    )


KHZ = rl.ReleaseConfig(frame_ms=16.0, high_band_hz=100.0, flux_hz=100.0, low_hz=20.0)


@cat.query("g9_release_features")
def release_levels(spark, folder):
    f = rl.release_features(sample_windows(spark, folder), KHZ)
    return f.select("event_id", F.posexplode("broadband_db").alias("frame", "db")).select("event_id", "frame", F.round("db", 4).alias("db"))


@cat.query("g11_rank_candidates")
def ranked(spark, folder):
    f = rl.release_features(sample_windows(spark, folder), KHZ)
    return rl.rank_candidates(f, KHZ).select("event_id", "frame", F.round("score", 4).alias("score"), "attribution")


@cat.query("g10_burst_evidence")
def evidence(spark, folder):
    w = sample_windows(spark, folder)
    c = rl.rank_candidates(rl.release_features(w, KHZ), KHZ)
    return rl.burst_evidence(c, w, KHZ).select("event_id", "frame", "broadband_release_evidence", F.round("burst_spectral_flatness", 4).alias("flatness"))


@cat.query("g12_estimate_release")
def estimates(spark, folder):
    w = cut_lineage(sample_windows(spark, folder))
    f = cut_lineage(rl.release_features(w, KHZ))
    c = rl.burst_evidence(rl.rank_candidates(f, KHZ), w, KHZ)
    tokens = w.select("event_id", F.lit("p").alias("phone_class"), F.array().cast("array<double>").alias("occurrence_anchors"), F.lit(0).alias("occurrence_index"))
    out = rl.estimate_release(c, f, tokens, KHZ)
    return out.select("event_id", "measurable", "confidence", r6("release_time_s").alias("release_time_s"), F.concat_ws(",", "exclusion_reasons").alias("reasons"))
