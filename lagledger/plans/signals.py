"""Frame, clip and group feature queries on 64-sample frames at a nominal 16 kHz."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lagledger.functions import vectors as vx
from lagledger.functions.numeric import bbox_diagonal, bbox_iou, dbfs, hz_to_mel, mel_to_hz, r6, size_change
from lagledger.operators import compare as cp
from lagledger.operators import signal as sg
from lagledger.operators.ledger import reconcile
from lagledger.operators.quantiles import distribution
from lagledger.operators.ranking import nearest_with_ties
from lagledger.operators.scan import Slicing
from lagledger.operators.timeline import reuse_join
from lagledger.plans.catalogue import Catalogue
from lagledger.session import cut_lineage
from lagledger.plans.standins import CLIPS_SQL, E_SQL, HOUR_US, clips, stream, table
from lagledger.functions.numeric import designated_relations

cat = Catalogue()
RATE = 16_000
CONFIG = sg.FrameConfig(sample_rate=RATE, mel_bands=8, mel_high=7000.0)
WIDE = Slicing(width=1_000_000)
INT = "cast({} AS BIGINT)"

SAMPLES_SQL = f"v AS ({CLIPS_SQL}), s AS (SELECT vec_id, clip_id, frame_index, group_id, unnest(samples) AS x, unnest(range(64)) AS i FROM v)"
HANN = f"(0.5 - 0.5 * cos({2 * math.pi!r} * i / 63))"
# Power spectrum by definition: 33 bins of a 64-point transform.
POWER_SQL = f"""{SAMPLES_SQL}, h AS (SELECT vec_id, i, x * {HANN} AS y FROM s), b AS (SELECT unnest(range(33)) AS k),
pw AS (SELECT vec_id, k, k * 250.0 AS hz, (sum(y * cos({2 * math.pi!r} * k * i / 64)) ** 2 + sum(y * sin({2 * math.pi!r} * k * i / 64)) ** 2)
  / (SELECT sum({HANN} ** 2) FROM (SELECT unnest(range(64)) AS i)) AS p FROM h CROSS JOIN b GROUP BY ALL),
sp AS (SELECT *, sum(p) OVER (PARTITION BY vec_id) AS tot, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS cum FROM pw),
ce AS (SELECT vec_id, sum(p * hz) / sum(p) AS centre FROM pw GROUP BY 1)"""


def features(spark, folder, with_mel=False):
    base = clips(spark, folder).select("vec_id", "clip_id", "group_id", "samples")
    return sg.frame_features(base, CONFIG, with_mel=with_mel)


@cat.query(
    "f1_dbfs",
    f"WITH {SAMPLES_SQL} SELECT vec_id, round(20 * log10(greatest(sqrt(avg(x * x)), 1e-12)), 6) AS dbfs FROM s GROUP BY 1",
)
def level(spark, folder):
    return clips(spark, folder).select("vec_id", r6(dbfs(vx.rms(F.col("samples")))).alias("dbfs"))


@cat.query(
    "f2_mel_scale",
    f"WITH e AS ({E_SQL}) SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(700 * (10 ** (value / 2595) - 1), 6) AS hz FROM e",
)
def mel(spark, folder):
    return stream(spark, folder).select("event_id", r6(hz_to_mel("value")).alias("mel"), r6(mel_to_hz("value")).alias("hz"))


PREV_SQL = f"v AS ({CLIPS_SQL}), n AS (SELECT a.vec_id, a.samples AS a, b.samples AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


def neighbours(spark, folder):
    v = clips(spark, folder).select("vec_id", F.col("samples").alias("a"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@cat.query("f8_cosine_distance", f"WITH {PREV_SQL} SELECT vec_id, round(1 - list_cosine_similarity(a, b), 6) AS distance FROM n")
def cosine(spark, folder):
    return neighbours(spark, folder).select("vec_id", r6(vx.cosine_distance("a", "b")).alias("distance"))


BOX = "[{v}[1], {v}[2], {v}[1] + abs({v}[3]) + 0.05, {v}[2] + abs({v}[4]) + 0.05]"


@cat.query(
    "f9_bbox_measures",
    f"""WITH {PREV_SQL}, x AS (SELECT vec_id, {BOX.format(v='a')} AS p, {BOX.format(v='b')} AS q FROM n),
y AS (SELECT *, greatest(0, least(p[3], q[3]) - greatest(p[1], q[1])) * greatest(0, least(p[4], q[4]) - greatest(p[2], q[2])) AS o,
 (p[3] - p[1]) * (p[4] - p[2]) AS pa, (q[3] - q[1]) * (q[4] - q[2]) AS qa FROM x)
SELECT vec_id, round(o / greatest(pa + qa - o, 1e-9), 6) AS iou, round(sqrt((p[3] - p[1]) ** 2 + (p[4] - p[2]) ** 2), 6) AS diagonal, round(abs(ln(qa / pa)), 6) AS size_change FROM y""",
)
def boxes(spark, folder):
    box = lambda v: F.array(
        F.col(v)[0], F.col(v)[1], F.col(v)[0] + F.abs(F.col(v)[2]) + 0.05, F.col(v)[1] + F.abs(F.col(v)[3]) + 0.05
    )
    n = neighbours(spark, folder).select("vec_id", box("a").alias("p"), box("b").alias("q"))
    return n.select(
        "vec_id", r6(bbox_iou("p", "q")).alias("iou"), r6(bbox_diagonal("p")).alias("diagonal"), r6(size_change("p", "q")).alias("size_change")
    )


@cat.query(
    "f10_three_pair_stats",
    f"WITH v AS ({CLIPS_SQL}), x AS (SELECT vec_id, list_sort(samples[1:3]) AS s FROM v) SELECT vec_id, round(s[2], 6) AS pair_median, round(s[3], 6) AS pair_maximum, round(s[3] - s[1], 6) AS pair_spread FROM x",
)
def pairs(spark, folder):
    three = vx.three_pair_stats(F.slice("samples", 1, 3))
    return clips(spark, folder).select("vec_id", *[r6(c).alias(n) for n, c in three.items()])


@cat.query(
    "f11_aperture",
    f"""WITH v AS ({CLIPS_SQL}), x AS (SELECT vec_id, samples[3] - samples[1] AS ax, samples[4] - samples[2] AS ay, samples[7] - samples[5] AS dx, samples[8] - samples[6] AS dy FROM v)
SELECT vec_id, round(abs(dx * -ay + dy * ax) / (ax * ax + ay * ay), 4) AS aperture FROM x""",
)
def lips(spark, folder):
    s = F.col("samples")
    a = vx.aperture(s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[7])
    return clips(spark, folder).select("vec_id", F.round(a, 4).alias("aperture"))


@cat.query(
    "f19_detection_quality",
    f"""WITH v AS ({CLIPS_SQL}), x AS (SELECT vec_id, 60 + 300 * abs(samples[1]) AS fw, 10 + 100 * abs(samples[2]) AS mw, 0.9 + abs(samples[3]) AS vis, 0.9 + abs(samples[4]) AS lip, 20 * abs(samples[5]) AS tex FROM v)
SELECT vec_id, CASE WHEN fw < 96 OR mw < 20 OR lip < 0.98 THEN 0.0 ELSE round(least(1, greatest(0, least(1, fw / 144, mw / 30)
 * least(1, greatest(0, (mw / fw - 0.10) / 0.13)) * vis * (0.65 + 0.35 * least(1, tex / 5)))), 6) END AS quality FROM x""",
)
def detection(spark, folder):
    s = F.col("samples")
    q = vx.detection_quality(60 + 300 * F.abs(s[0]), 10 + 100 * F.abs(s[1]), 0.9 + F.abs(s[2]), 0.9 + F.abs(s[3]), 20 * F.abs(s[4]))
    return clips(spark, folder).select("vec_id", r6(q).alias("quality"))


@cat.query(
    "g1_frame_signal",
    f"""WITH {SAMPLES_SQL}, f AS (SELECT unnest(range(7)) AS f) SELECT vec_id, f::INTEGER AS frame_index, round((f * 8 + 8) / 16000, 6) AS clip_time_s, round(sum(x), 6) AS total
FROM s JOIN f ON i BETWEEN f * 8 AND f * 8 + 15 GROUP BY ALL""",
)
def framed(spark, folder):
    f = sg.frame_signal(clips(spark, folder).select("vec_id", "samples"), "samples", 16, 8, RATE)
    return f.select("vec_id", "frame_index", r6("clip_time_s").alias("clip_time_s"), r6(vx.total(F.col("samples"))).alias("total"))


LEVEL_SQL = f"""{SAMPLES_SQL}, l AS (SELECT vec_id, clip_id, group_id, 20 * log10(greatest(sqrt(avg(x * x)), 1e-12)) AS db FROM s GROUP BY ALL),
th AS (SELECT clip_id, least(-30.0, greatest(-55.0, quantile_cont(db, 0.1) + 10)) AS th FROM l GROUP BY 1)"""


@cat.query(
    "g2_frame_level",
    f"WITH {LEVEL_SQL} SELECT vec_id, round(db, 6) AS rms_dbfs, round(th, 6) AS threshold, db >= th AS active FROM l JOIN th USING (clip_id)",
)
def levels(spark, folder):
    f = sg.activity(sg.frame_level(clips(spark, folder)), ["clip_id"])
    return f.select("vec_id", r6("rms_dbfs").alias("rms_dbfs"), r6("activity_threshold").alias("threshold"), "active")


@cat.query(
    "a18_activity_threshold",
    f"WITH {LEVEL_SQL} SELECT clip_id, round(any_value(th), 6) AS threshold, round(avg((db >= th)::INT), 6) AS active_fraction FROM l JOIN th USING (clip_id) GROUP BY 1",
)
def threshold(spark, folder):
    f = sg.activity(sg.frame_level(clips(spark, folder)), ["clip_id"])
    return f.groupBy("clip_id").agg(
        r6(F.max("activity_threshold")).alias("threshold"), r6(F.avg(F.col("active").cast("int"))).alias("active_fraction")
    )


LAG_SQL = f"""{SAMPLES_SQL}, m AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY vec_id)) * {HANN} AS y FROM s), lg AS (SELECT unnest(range(53, 63)) AS lag),
ac AS (SELECT a.vec_id, lag, sum(a.y * b.y) AS r, sum(a.y * a.y) AS le, sum(b.y * b.y) AS re FROM m a CROSS JOIN lg JOIN m b ON b.vec_id = a.vec_id AND b.i = a.i + lag GROUP BY ALL),
co AS (SELECT vec_id, lag, least(1, greatest(-1, r / sqrt(greatest(le * re, 1e-12)))) AS c FROM ac),
nb AS (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS q, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, lag) AS rn FROM co WINDOW w AS (PARTITION BY vec_id ORDER BY lag)),
f0 AS (SELECT vec_id, greatest(0, least(1, c)) AS periodicity, 16000 / (lag + CASE WHEN p IS NULL OR q IS NULL OR abs(p - 2 * c + q) <= 1e-9 THEN 0
 ELSE greatest(-0.5, least(0.5, 0.5 * (p - q) / (p - 2 * c + q))) END) AS f0 FROM nb WHERE rn = 1)"""


@cat.query(
    "g3_frame_f0",
    f"WITH {LAG_SQL} SELECT vec_id, round(periodicity, 6) AS periodicity, round(f0, 4) AS f0_hz FROM f0",
)
def pitch(spark, folder):
    return features(spark, folder).select("vec_id", r6("periodicity").alias("periodicity"), F.round("f0_candidate_hz", 4).alias("f0_hz"))


@cat.query(
    "g4_frame_spectrum",
    f"""WITH {POWER_SQL} SELECT vec_id, round(any_value(centre), 4) AS centroid, round(sqrt(sum(p * (hz - centre) ** 2) / any_value(tot)), 4) AS bandwidth,
 min(CASE WHEN cum >= 0.85 * tot THEN hz END)::DOUBLE AS rolloff, round(exp(avg(ln(p + 1e-12))) / avg(p), 6) AS flatness FROM sp JOIN ce USING (vec_id) GROUP BY 1""",
)
def spectrum(spark, folder):
    return features(spark, folder).select(
        "vec_id", F.round("spectral_centroid_hz", 4).alias("centroid"), F.round("spectral_bandwidth_hz", 4).alias("bandwidth"),
        F.col("spectral_rolloff_85_hz").alias("rolloff"), r6("spectral_flatness").alias("flatness"),
    )


BAND_SQL = f"""{POWER_SQL}, bf AS (SELECT vec_id, sum(p) FILTER (hz < 500) / any_value(tot) AS low, sum(p) FILTER (hz >= 500 AND hz < 2000) / any_value(tot) AS mid,
 sum(p) FILTER (hz >= 2000 AND hz <= 8000) / any_value(tot) AS high, sum(p) FILTER (hz >= 8000) / any_value(tot) AS upper FROM sp GROUP BY 1)"""


@cat.query(
    "g5_band_fractions",
    f"WITH {BAND_SQL} SELECT vec_id, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, round(upper, 6) AS upper FROM bf",
)
def bands(spark, folder):
    f = features(spark, folder)
    short = dict(zip([b for b, _, _ in sg.BANDS], ["low", "mid", "high", "upper"]))
    return f.select("vec_id", *[r6(f"band_fraction_{b}").alias(s) for b, s in short.items()])


STEREO_SQL = f"""v AS ({CLIPS_SQL}), st AS (SELECT vec_id, clip_id, unnest(samples[1:32]) AS l, unnest(samples[33:64]) AS r FROM v),
sd AS (SELECT vec_id, any_value(clip_id) AS clip_id, 20 * log10(greatest(sqrt(avg(l * l)), 1e-12) / greatest(sqrt(avg(r * r)), 1e-12)) AS balance, corr(l, r) AS correlation,
 avg(((l - r) / 2) ** 2) / greatest(avg(((l + r) / 2) ** 2) + avg(((l - r) / 2) ** 2), 1e-12) AS side, 20 * log10(greatest(sqrt(avg(l * l)), 1e-12)) AS left_db FROM st GROUP BY 1)"""


def stereo(spark, folder):
    s = clips(spark, folder)
    return s.withColumns(sg.stereo_diagnostics(F.slice("samples", 1, 32), F.slice("samples", 33, 32)))


@cat.query(
    "g6_stereo_diagnostics",
    f"WITH {STEREO_SQL} SELECT vec_id, round(left_db, 6) AS left_db, round(balance, 6) AS balance_db, round(correlation, 6) AS correlation, round(side, 6) AS side_fraction FROM sd",
)
def stereo_rows(spark, folder):
    return stereo(spark, folder).select(
        "vec_id", r6("left_rms_dbfs").alias("left_db"), r6("stereo_balance_db").alias("balance_db"),
        r6("stereo_correlation").alias("correlation"), r6("stereo_side_fraction").alias("side_fraction"),
    )


@cat.query(
    "g7_log_mel",
    f"""WITH {POWER_SQL}, mp AS (SELECT j, 700 * (10 ** ((2595 * log10(1 + 50 / 700) + j * (2595 * log10(1 + 7000 / 700) - 2595 * log10(1 + 50 / 700)) / 9) / 2595) - 1) AS f FROM (SELECT unnest(range(10)) AS j)),
tri AS (SELECT a.j AS band, a.f AS l, b.f AS c, d.f AS r FROM mp a JOIN mp b ON b.j = a.j + 1 JOIN mp d ON d.j = a.j + 2),
wt AS (SELECT band, k, greatest(0, least((k * 250.0 - l) / (c - l), (r - k * 250.0) / (r - c))) AS w FROM tri CROSS JOIN b),
nw AS (SELECT band, k, w / CASE WHEN sum(w) OVER (PARTITION BY band) > 1e-12 THEN sum(w) OVER (PARTITION BY band) ELSE 1 END AS w FROM wt)
SELECT vec_id, band::INTEGER AS band, round(10 * log10(sum(p * w) + 1e-12), 6) AS level FROM pw JOIN nw USING (k) GROUP BY ALL""",
)
def log_mel(spark, folder):
    f = features(spark, folder, with_mel=True)
    return f.select("vec_id", F.posexplode("log_mel").alias("band", "level")).select("vec_id", "band", r6("level").alias("level"))


def clip_table(spark, folder):
    """The registered metrics per clip (ten frames), from judged frames."""
    frames = stereo(spark, folder).withColumn("_s", F.col("samples"))
    rated = sg.activity(sg.frame_level(frames).drop("_s"), ["clip_id"])
    full = sg.frame_features(rated.select(
        "vec_id", "clip_id", "rms_dbfs", "active", "stereo_balance_db", "stereo_correlation", "stereo_side_fraction", "samples"
    ), CONFIG)
    judged = sg.voiced_pitch(full, CONFIG)
    # The Arrow kernel is the costly step and feeds two aggregates: keep its rows.
    judged = cut_lineage(judged)
    whole = sg.clip_waveform(clips(spark, folder), ["clip_id"], RATE)
    label = clips(spark, folder).groupBy("clip_id").agg(F.min("group_id").alias("group_id"))
    return sg.clip_summary(judged, whole, ["clip_id"]).join(label, "clip_id")


JOINED_SQL = f"""WITH {SAMPLES_SQL}, {POWER_SQL.replace(SAMPLES_SQL + ', ', '')}, {BAND_SQL.replace(POWER_SQL + ', ', '')}, {LEVEL_SQL.replace(SAMPLES_SQL + ', ', '')},
{LAG_SQL.replace(SAMPLES_SQL + ', ', '')}, {STEREO_SQL.replace('v AS (' + CLIPS_SQL + '), ', '')},
fr AS (SELECT l.vec_id, l.clip_id, l.db >= th.th AS active, f0.periodicity, CASE WHEN l.db >= th.th AND f0.periodicity >= 0.35 THEN f0.f0 END AS f0, ce.centre, sd.balance, bf.low
 FROM l JOIN th USING (clip_id) JOIN f0 USING (vec_id) JOIN ce USING (vec_id) JOIN sd USING (vec_id) JOIN bf USING (vec_id)),
cm AS (SELECT clip_id, avg(active::INT) AS active_frame_fraction, count(f0) / nullif(count(*) FILTER (active), 0) AS voiced_fraction_of_active, median(f0) AS f0_median_hz,
 median(periodicity) FILTER (active) AS periodicity_median, median(centre) FILTER (active) AS spectral_centroid_median_hz, median(balance) FILTER (active) AS stereo_balance_median_db,
 avg(low) FILTER (active) AS low_fraction, count(*) * 64 / 16000 AS duration_s FROM fr GROUP BY 1),
cr AS (SELECT clip_id, 20 * log10(sqrt(avg(x * x))) AS rms_dbfs, min(group_id) AS group_id FROM s GROUP BY 1)"""


@cat.query(
    "g8_clip_summary",
    f"""{JOINED_SQL} SELECT clip_id, round(duration_s, 6) AS duration_s, round(active_frame_fraction, 6) AS active_frame_fraction, round(voiced_fraction_of_active, 6) AS voiced_fraction_of_active,
 round(f0_median_hz, 4) AS f0_median_hz, round(periodicity_median, 6) AS periodicity_median, round(rms_dbfs, 6) AS rms_dbfs, round(spectral_centroid_median_hz, 4) AS spectral_centroid_median_hz,
 round(stereo_balance_median_db, 6) AS stereo_balance_median_db, round(low_fraction, 6) AS mean_active_band_fraction_low_0_500 FROM cm JOIN cr USING (clip_id)""",
)
def clip_rows(spark, folder):
    names = ["duration_s", "active_frame_fraction", "voiced_fraction_of_active", "periodicity_median", "rms_dbfs", "stereo_balance_median_db", "mean_active_band_fraction_low_0_500"]
    return clip_table(spark, folder).select(
        "clip_id", *[r6(n).alias(n) for n in names], *[F.round(n, 4).alias(n) for n in ("f0_median_hz", "spectral_centroid_median_hz")]
    )


# Simple clip metrics that SQL can repeat cheaply, for the group comparisons.
SIMPLE = ["rms_dbfs", "peak_dbfs", "dc_offset", "clipped_fraction"]
SIMPLE_SQL = f"""{SAMPLES_SQL}, c AS (SELECT vec_id, group_id, 20 * log10(greatest(sqrt(avg(x * x)), 1e-12)) AS rms_dbfs, 20 * log10(greatest(max(abs(x)), 1e-12)) AS peak_dbfs,
 avg(x) AS dc_offset, avg((abs(x) >= 0.999)::INT) AS clipped_fraction FROM s GROUP BY ALL),
u AS (UNPIVOT (SELECT vec_id, group_id, rms_dbfs, peak_dbfs, dc_offset, clipped_fraction FROM c) ON rms_dbfs, peak_dbfs, dc_offset, clipped_fraction INTO NAME metric_id VALUE value),
g AS (SELECT group_id, metric_id, count(value) AS value_count, min(value) AS lo, max(value) AS hi, median(value) AS mid FROM u GROUP BY ALL),
d AS (SELECT metric_id, value AS dv FROM u WHERE vec_id = (SELECT min(vec_id) FROM v))"""


def simple_clips(spark, folder):
    return clips(spark, folder).select("vec_id", "group_id", *[c.alias(n) for n, c in sg.waveform_summary(F.col("samples")).items()])


@cat.query(
    "a17_waveform_summary",
    f"WITH {SIMPLE_SQL} SELECT vec_id, round(rms_dbfs, 6) AS rms_dbfs, round(peak_dbfs, 6) AS peak_dbfs, round(dc_offset, 6) AS dc_offset, clipped_fraction FROM c",
)
def waveform(spark, folder):
    return simple_clips(spark, folder).select(
        "vec_id", r6("rms_dbfs").alias("rms_dbfs"), r6("peak_dbfs").alias("peak_dbfs"), r6("dc_offset").alias("dc_offset"), "clipped_fraction"
    )


def group_table(spark, folder):
    return cp.group_metrics(simple_clips(spark, folder), "group_id", SIMPLE)


@cat.query(
    "a2_group_metrics",
    f"WITH {SIMPLE_SQL} SELECT group_id, metric_id, value_count, round(lo, 6) AS min, round(hi, 6) AS max, round(mid, 6) AS median FROM g",
)
def groups(spark, folder):
    return group_table(spark, folder).select(
        "group_id", "metric_id", "value_count", r6("min").alias("min"), r6("max").alias("max"), r6("median").alias("median")
    )


@cat.query(
    "a3_distribution",
    f"""WITH e AS ({E_SQL}) SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25,
 round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM e GROUP BY 1""",
)
def spreads(spark, folder):
    d = distribution(stream(spark, folder), ["event_type"], "value")
    return d.select("event_type", "count", *[r6(c).alias(c) for c in ("mean", "p05", "p25", "median", "p75", "p95", "iqr")])


def designated(spark, folder):
    v = simple_clips(spark, folder)
    first = v.groupBy().agg(F.min_by(F.struct(*SIMPLE), "vec_id").alias("m")).select("m.*")
    return cp.long_metrics(first.withColumn("_k", F.lit(0)), ["_k"], SIMPLE).drop("_k")


def comparison(spark, folder):
    return cp.designated_comparison(group_table(spark, folder), designated(spark, folder), "group_id")


@cat.query(
    "j13_designated_join",
    f"""WITH {SIMPLE_SQL} SELECT group_id, metric_id, round(dv, 6) AS designated_value, round(mid - dv, 6) AS signed_delta, round(abs(mid - dv), 6) AS absolute_delta, dv BETWEEN lo AND hi AS inside_range FROM g JOIN d USING (metric_id)""",
)
def compared(spark, folder):
    return comparison(spark, folder).select(
        "group_id", "metric_id", r6("designated_value").alias("designated_value"), r6("signed_delta").alias("signed_delta"),
        r6("absolute_delta").alias("absolute_delta"), "inside_range",
    )


@cat.query(
    "f21_designated_relations",
    """WITH s AS (SELECT s_nationkey AS k, min(s_acctbal) AS lo, max(s_acctbal) AS hi, median(s_acctbal) AS mid FROM supplier GROUP BY 1)
SELECT c_custkey, c_acctbal >= lo AND c_acctbal <= hi AS inside_range, round(mid - c_acctbal, 6) AS signed_delta, round(abs(mid - c_acctbal), 6) AS absolute_delta
FROM customer LEFT JOIN s ON k = c_nationkey""",
)
def relations(spark, folder):
    """A customer's balance against the range of the suppliers of the same nation; NULL where a nation has none."""
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(
        F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.median("s_acctbal").alias("mid")
    )
    c = table(spark, folder, "customer").join(s, "c_nationkey", "left")
    r = designated_relations("lo", "hi", "mid", "c_acctbal")
    return c.select("c_custkey", r["inside_range"].alias("inside_range"), r6(r["signed_delta"]).alias("signed_delta"), r6(r["absolute_delta"]).alias("absolute_delta"))


@cat.query(
    "t7_nearest_with_ties",
    f"""WITH {SIMPLE_SQL}, a AS (SELECT group_id, metric_id, abs(mid - dv) AS x, min(abs(mid - dv)) OVER (PARTITION BY metric_id) AS m FROM g JOIN d USING (metric_id))
SELECT group_id, metric_id FROM a WHERE x - m <= greatest(1e-12, 1e-12 * x)""",
)
def nearest_groups(spark, folder):
    return nearest_with_ties(comparison(spark, folder), "metric_id", "signed_delta").select("group_id", "metric_id")


@cat.query(
    "x10_recompute_diff",
    f"""WITH {SIMPLE_SQL}, st AS (SELECT *, mid + CASE WHEN group_id % 4 = 0 AND metric_id = 'rms_dbfs' THEN 1e-3 ELSE 0 END AS m2 FROM g WHERE NOT (group_id = 1 AND metric_id = 'dc_offset'))
SELECT g.group_id, g.metric_id, CASE WHEN st.metric_id IS NULL THEN 'missing' ELSE 'median_differs' END AS differences FROM g LEFT JOIN st USING (group_id, metric_id) WHERE st.metric_id IS NULL OR abs(st.m2 - g.mid) > 1e-12""",
)
def recomputed(spark, folder):
    fresh = group_table(spark, folder).select("group_id", "metric_id", "median", "min", "max")
    off = (F.col("group_id") % 4 == 0) & (F.col("metric_id") == "rms_dbfs")
    stored = fresh.filter(~((F.col("group_id") == 1) & (F.col("metric_id") == "dc_offset"))).withColumn(
        "median", F.col("median") + F.when(off, 1e-3).otherwise(0.0)
    )
    return reconcile(stored, fresh, ["group_id", "metric_id"], 1e-12).select(
        "group_id", "metric_id", F.concat_ws(",", "differences").alias("differences")
    )


@cat.query(
    "j14_reconcile",
    f"""WITH v AS ({CLIPS_SQL}), a AS (SELECT clip_id, count(*) AS frames, min(group_id) AS group_id FROM v WHERE vec_id % 50 <> 7 GROUP BY 1), b AS (SELECT clip_id, count(*) AS frames, min(group_id) AS group_id FROM v WHERE clip_id % 9 <> 3 GROUP BY 1)
SELECT clip_id, concat_ws(',', CASE WHEN b.frames IS NULL THEN 'unexpected' END, CASE WHEN a.frames IS NULL THEN 'missing' END, CASE WHEN a.frames <> b.frames THEN 'frames_differs' END,
 CASE WHEN a.group_id <> b.group_id THEN 'group_id_differs' END) AS differences FROM a FULL JOIN b USING (clip_id) WHERE a.frames IS NULL OR b.frames IS NULL OR a.frames <> b.frames OR a.group_id <> b.group_id""",
)
def reconciled(spark, folder):
    v = clips(spark, folder)
    agg = lambda d: d.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.min("group_id").alias("group_id"))
    out = reconcile(agg(v.filter("vec_id % 50 <> 7")), agg(v.filter("clip_id % 9 <> 3")), ["clip_id"])
    return out.select("clip_id", F.concat_ws(",", "differences").alias("differences"))


@cat.query(
    "x11_registry_match",
    f"""WITH {SIMPLE_SQL}, r AS (SELECT unnest(['rms_dbfs', 'peak_dbfs', 'dc_offset', 'duration_s']) AS metric_id), k AS (SELECT DISTINCT group_id FROM g)
SELECT group_id, metric_id, 'metric_missing' AS problem FROM k CROSS JOIN r ANTI JOIN g USING (group_id, metric_id) UNION ALL SELECT group_id, metric_id, 'metric_not_registered' FROM g ANTI JOIN r USING (metric_id)""",
)
def registry(spark, folder):
    names = spark.createDataFrame([("rms_dbfs",), ("peak_dbfs",), ("dc_offset",), ("duration_s",)], "metric_id string")
    return cp.registry_mismatches(group_table(spark, folder), "group_id", names)


@cat.query(
    "x17_valid_group_stats",
    f"""WITH {SIMPLE_SQL}, n AS (SELECT group_id, count(*) - group_id % 3 AS clips FROM c GROUP BY 1), t AS (SELECT g.*, clips, CASE WHEN group_id = 2 THEN hi + 1 ELSE mid END AS m FROM g JOIN n USING (group_id))
SELECT group_id, metric_id, concat_ws(',', CASE WHEN value_count > clips THEN 'more_values_than_clips' END, CASE WHEN NOT (lo <= m AND m <= hi) THEN 'statistics_out_of_order' END) AS reasons FROM t""",
)
def group_stats(spark, folder):
    n = clips(spark, folder).groupBy("group_id").agg((F.count(F.lit(1)) - F.max(F.col("group_id")) % 3).alias("clips"))
    t = group_table(spark, folder).join(n, "group_id").withColumn(
        "median", F.when(F.col("group_id") == 2, F.col("max") + 1).otherwise(F.col("median"))
    )
    return cp.group_stats_reasons(t, "clips").select("group_id", "metric_id", F.concat_ws(",", "stats_reasons").alias("reasons"))


QUIET = "CASE WHEN abs(x) < 0.12 THEN 0.0 ELSE x END"


@cat.query(
    "a16_block_dropout",
    f"""WITH {SAMPLES_SQL}, q AS (SELECT vec_id, i // 2 AS b, {QUIET} AS x FROM s), bl AS (SELECT vec_id, b, sum(x * x) AS e, count(*) AS n, max(abs(x)) AS p, count(*) FILTER (abs(x) > 1e-7) AS z FROM q GROUP BY ALL),
k AS (SELECT *, sqrt(e / n) < 1e-5 AS quiet FROM bl), r AS (SELECT vec_id, b - row_number() OVER (PARTITION BY vec_id, quiet ORDER BY b) AS isl, quiet FROM k),
lr AS (SELECT vec_id, max(n) AS longest FROM (SELECT vec_id, isl, count(*) AS n FROM r WHERE quiet GROUP BY ALL) GROUP BY 1)
SELECT vec_id, round(sqrt(sum(e) / sum(n)), 6) AS rms, round(max(p), 6) AS peak, count(*) AS block_count, count(*) FILTER (quiet) AS near_zero_blocks, round(sum(z) / sum(n), 6) AS nonzero_fraction,
 coalesce(any_value(longest), 0) AS longest_quiet_blocks FROM k LEFT JOIN lr USING (vec_id) GROUP BY 1""",
)
def dropout(spark, folder):
    s = clips(spark, folder).select("vec_id", F.posexplode("samples").alias("i", "x")).withColumn(
        "x", F.when(F.abs("x") < 0.12, 0.0).otherwise(F.col("x"))
    )
    d = sg.block_dropout(s, ["vec_id"], "i", "x", 2, WIDE)
    return d.select(
        "vec_id", r6("rms").alias("rms"), r6("peak").alias("peak"), "block_count", "near_zero_blocks",
        r6("nonzero_fraction").alias("nonzero_fraction"), "longest_quiet_blocks",
    )


@cat.query(
    "a22_minmax_bins",
    f"""WITH {SAMPLES_SQL}, b AS (SELECT vec_id, ((i + 1) * 10 - 1) // 64 AS bin, min(x) AS lo, max(x) AS hi, sqrt(avg(x * x)) AS r FROM s GROUP BY ALL),
k AS (SELECT vec_id, greatest(max(greatest(abs(lo), abs(hi))), 1e-9) AS peak, quantile_cont(r, 0.99) AS p FROM b GROUP BY 1)
SELECT vec_id, bin, round(lo / peak, 6) AS low, round(hi / peak, 6) AS high, round(least(1, r / p), 6) AS envelope FROM b JOIN k USING (vec_id)""",
)
def bins(spark, folder):
    s = clips(spark, folder).select("vec_id", F.size("samples").alias("n"), F.posexplode("samples").alias("i", "x"))
    b = sg.minmax_bins(s, ["vec_id"], "i", "x", 10, "n")
    return b.select("vec_id", "bin", r6("low").alias("low"), r6("high").alias("high"), r6("envelope").alias("envelope"))


@cat.query(
    "j16_reuse_join",
    f"""WITH v AS ({CLIPS_SQL}), n AS (SELECT clip_id AS event_id, frame_index AS source_index, samples FROM v WHERE frame_index <> 9),
w AS (SELECT clip_id AS event_id, frame_index AS source_index, samples, c FROM v, (SELECT unnest(range(4)) AS c) WHERE NOT (frame_index = 3 AND c = 0 AND clip_id % 2 = 0)),
d AS (SELECT w.event_id, w.source_index, n.samples IS NOT NULL AS found, CASE WHEN n.samples IS NOT NULL THEN 0.0 END AS diff FROM w LEFT JOIN n USING (event_id, source_index))
SELECT event_id, source_index, count(*) AS copies, count(*) = 4 AS hold_ok, bool_or(found) AS in_normal, round(avg(diff), 6) AS mean_difference FROM d GROUP BY ALL""",
)
def reuse(spark, folder):
    v = clips(spark, folder).select(F.col("clip_id").alias("event_id"), F.col("frame_index").alias("source_index"), "samples")
    slow = v.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter(
        "NOT (source_index = 3 AND c = 0 AND event_id % 2 = 0)"
    )
    r = reuse_join(slow, v.filter("source_index <> 9"), 4, "samples")
    return r.select("event_id", "source_index", "copies", "hold_ok", "in_normal", r6("mean_difference").alias("mean_difference"))


@cat.query(
    "j19_lag_correlation",
    f"""WITH {PREV_SQL}, r AS (SELECT vec_id, unnest(a[9:56]) AS x, unnest(range(48)) AS i FROM n), t AS (SELECT vec_id, unnest(list_transform(list_zip(a, b), lambda z: z[1] + 0.2 * z[2])) AS y, unnest(range(64)) AS i FROM n),
rc AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM r), lg AS (SELECT unnest(range(17)) AS lag),
c AS (SELECT rc.vec_id, lag, sum(x * y) / sqrt((sum(y * y) - sum(y) ** 2 / 48) * sum(x * x)) AS c FROM rc CROSS JOIN lg JOIN t ON t.vec_id = rc.vec_id AND t.i = rc.i + lag GROUP BY ALL)
SELECT vec_id, round(max(c), 6) AS peak_correlation, arg_max(lag, c) AS best_lag, max(c) >= 0.95 AS passed FROM c GROUP BY 1""",
)
def correlated(spark, folder):
    n = neighbours(spark, folder).select(
        "vec_id", F.slice("a", 9, 48).alias("ref"), F.zip_with("a", "b", lambda x, y: x + 0.2 * y).alias("target")
    )
    return sg.lag_correlation(n, "ref", "target").select("vec_id", r6("peak_correlation").alias("peak_correlation"), "best_lag", "passed")


@cat.query(
    "j20_preservation",
    f"""WITH {PREV_SQL}, z AS (SELECT vec_id, unnest(a) AS x, unnest(list_transform(list_zip(a, b), lambda z: z[1] + 0.05 * z[2])) AS y, unnest(range(64)) AS i FROM n),
m AS (SELECT * FROM z WHERE i BETWEEN 6 AND 57) SELECT vec_id, 0::BIGINT AS alignment_lag, round(corr(x, y), 6) AS correlation, round(20 * log10(sqrt(avg(y * y)) / sqrt(avg(x * x))), 6) AS rms_delta_db,
 round(sqrt(avg((y - x) ** 2)) / sqrt(avg(x * x)), 6) AS nrmse, corr(x, y) >= 0.97 AND abs(20 * log10(sqrt(avg(y * y)) / sqrt(avg(x * x)))) <= 1.5 AND sqrt(avg((y - x) ** 2)) / sqrt(avg(x * x)) <= 0.30 AS passed FROM m GROUP BY 1""",
)
def preserved(spark, folder):
    n = neighbours(spark, folder).select("vec_id", F.col("a").alias("ref"), F.zip_with("a", "b", lambda x, y: x + 0.05 * y).alias("out"))
    # Zero lag is forced by the reach: SQL has no search over lags here.
    p = sg.preservation(n, "ref", "out", decimate=4, reach=0)
    return p.select(
        "vec_id", "alignment_lag", r6("normalized_correlation").alias("correlation"), r6("rms_delta_db").alias("rms_delta_db"),
        r6("normalized_rmse").alias("nrmse"), "passed",
    )


@cat.query(
    "j20_stereo_preservation",
    f"""WITH {PREV_SQL}, z AS (SELECT vec_id, unnest(a) AS x1, unnest(b) AS x2, unnest(list_transform(list_zip(a, b), lambda z: z[1] + 0.36 * z[2])) AS y1, unnest(list_transform(b, lambda z: 0.95 * z + 0.01)) AS y2, unnest(range(64)) AS i FROM n),
m AS (SELECT vec_id, covar_pop(x1, y1) + covar_pop(x2, y2) AS c, (var_pop(x1) + var_pop(x2)) * (var_pop(y1) + var_pop(y2)) AS v, avg(x1 * x1 + x2 * x2) / 2 AS xx, avg(y1 * y1 + y2 * y2) / 2 AS yy,
 avg((y1 - x1) ** 2 + (y2 - x2) ** 2) / 2 AS d FROM z WHERE i BETWEEN 6 AND 57 GROUP BY 1)
SELECT vec_id, 0::BIGINT AS alignment_lag, round(c / sqrt(v), 6) AS correlation, round(10 * log10(yy / xx), 6) AS rms_delta_db, round(sqrt(d / xx), 6) AS nrmse,
 c / sqrt(v) >= 0.97 AND abs(10 * log10(yy / xx)) <= 1.5 AND sqrt(d / xx) <= 0.30 AS passed FROM m""",
)
def preserved_stereo(spark, folder):
    """Two channels a window, one joint figure."""
    left = F.zip_with("a", "b", lambda x, y: x + 0.36 * y)
    n = neighbours(spark, folder).select(
        "vec_id", F.array("a", "b").alias("ref"), F.array(left, F.transform("b", lambda x: 0.95 * x + 0.01)).alias("out")
    )
    p = sg.preservation(n, "ref", "out", decimate=4, reach=0)
    return p.select(
        "vec_id", "alignment_lag", r6("normalized_correlation").alias("correlation"), r6("rms_delta_db").alias("rms_delta_db"),
        r6("normalized_rmse").alias("nrmse"), "passed",
    )


def chunks(spark, folder):
    """Ten 64-sample chunks per clip, each 4 samples early, one in seven missing."""
    v = clips(spark, folder).filter("vec_id % 7 <> 5")
    return v.select("clip_id", (F.col("frame_index") * 60 / F.lit(16000.0)).alias("start_s"), "samples")


@cat.query(
    "g15_place_samples",
    f"""WITH {SAMPLES_SQL}, p AS (SELECT clip_id, frame_index * 60 + i AS k, x FROM s WHERE vec_id % 7 <> 5), a AS (SELECT clip_id, k, avg(x) AS value FROM p WHERE k < 600 GROUP BY ALL), c AS (SELECT DISTINCT clip_id FROM p)
SELECT clip_id, k AS sample_index, round(value, 6) AS value, value IS NOT NULL AS covered FROM c CROSS JOIN (SELECT unnest(range(600)) AS k) LEFT JOIN a USING (clip_id, k)""",
)
def placed(spark, folder):
    p = sg.place_samples(chunks(spark, folder), ["clip_id"], "start_s", "samples", RATE, 0.0, 600)
    return p.select("clip_id", "sample_index", r6("value").alias("value"), "covered")


@cat.query(
    "g14_chunk_diagnostics",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch_us(ts) - CASE WHEN event_id % 13 = 0 THEN {30 * HOUR_US} ELSE 0 END END AS s,
 floor(value * 1000)::BIGINT * 600000 AS d FROM events),
w AS (SELECT user_id, event_id, n, NULL::BIGINT AS last_end, s, d, CASE WHEN s IS NOT NULL THEN s + d END AS hi, s AS eff, NULL::BIGINT AS was FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, w.hi, e.s, e.d, CASE WHEN e.s IS NULL THEN w.hi + e.d ELSE greatest(w.hi, e.s + e.d) END,
  CASE WHEN coalesce(e.s, w.hi) - w.hi < -1000 THEN least(w.hi, coalesce(e.s, w.hi) + e.d) ELSE coalesce(e.s, w.hi) END, w.eff FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, s IS NULL AS missing_pts, coalesce(s - last_end > 1000, false) AS gap, coalesce(s - last_end < -1000, false) AS overlap, coalesce(s < was, false) AS reversed FROM w""",
)
def diagnostics(spark, folder):
    e = stream(spark, folder)
    shifted = F.col("t") - F.when(F.col("event_id") % 13 == 0, 30 * HOUR_US).otherwise(0)
    c = e.select(
        "user_id", "event_id", F.when(F.col("event_id") % 11 != 0, shifted).alias("s"),
        (F.floor(F.col("value") * 1000) * 600_000).alias("d"),
    )
    out = sg.chunk_diagnostics(c, ["user_id"], "event_id", "s", "d", 1000, Slicing(width=100_000))
    return out.select("event_id", "missing_pts", "gap", "overlap", "reversed")


# Event values in six-hour bins stand for audio energy in 10 ms bins.
BIN_US = 6 * HOUR_US
GRID_SQL = f"""x AS (SELECT user_id, epoch_us(ts) // {BIN_US} AS bin, value / 100 AS x, CASE WHEN event_id % 10 <> 0 THEN value / 300 END AS dx FROM events),
gs AS (SELECT user_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM x GROUP BY 1),
ag AS (SELECT user_id, bin, sum(x * x) AS e, count(*) AS n, coalesce(sum(dx * dx), 0) AS de, count(dx) AS dn FROM x GROUP BY ALL),
gb AS (SELECT user_id, bin, coalesce(e, 0) AS e, coalesce(n, 0) AS n, coalesce(de, 0) AS de, coalesce(dn, 0) AS dn FROM gs LEFT JOIN ag USING (user_id, bin)),
sm AS (SELECT user_id, bin, 0.75 * coalesce(lag(e) OVER w, 0) + e + 0.75 * coalesce(lead(e) OVER w, 0) AS e, 0.75 * coalesce(lag(n) OVER w, 0) + n + 0.75 * coalesce(lead(n) OVER w, 0) AS n,
 0.75 * coalesce(lag(de) OVER w, 0) + de + 0.75 * coalesce(lead(de) OVER w, 0) AS de, 0.75 * coalesce(lag(dn) OVER w, 0) + dn + 0.75 * coalesce(lead(dn) OVER w, 0) AS dn FROM gb WINDOW w AS (PARTITION BY user_id ORDER BY bin)),
ev AS (SELECT user_id, bin, CASE WHEN n >= 0.65 THEN 10 * log10(greatest(e / n, 1e-14)) END AS env, CASE WHEN dn >= 0.4225 THEN 10 * log10(greatest(de / dn, 1e-14)) END AS act FROM sm),
df AS (SELECT *, abs(env - lag(env) OVER w) AS a, 0.35 * abs(act - env - lag(act - env) OVER w) AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY bin)),
tr AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a + b ELSE coalesce(a, b) END AS raw FROM df),
t3 AS (SELECT *, count(raw) OVER w AS c, sum(raw) OVER w AS t FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


def grid_bins(spark, folder):
    e = stream(spark, folder).select(
        "user_id", F.floor(F.col("t") / BIN_US).alias("bin_t"), (F.col("value") / 100).alias("x"),
        F.when(F.col("event_id") % 10 != 0, F.col("value") / 300).alias("dx"),
    )
    made = sg.binned_audio(e, ["user_id"], "bin_t", "x", "dx", 1.0)
    span = made.groupBy("user_id").agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    grid = span.select("user_id", F.explode(F.sequence("a", "b")).alias("bin"))
    return grid.join(made, ["user_id", "bin"], "left").fillna(0)


def audio(spark, folder):
    # 100 bins per "second": the 25 ms kernel is (0.75, 1, 0.75), 30 ms is 3 bins.
    return sg.audio_features(grid_bins(spark, folder), ["user_id"], 100.0, 1.0, Slicing(width=100_000))


@cat.query(
    "w19_overlap_smooth",
    f"WITH {GRID_SQL} SELECT user_id, bin, round(env, 6) AS envelope, round(act, 6) AS activity FROM ev",
)
def smoothed(spark, folder):
    return audio(spark, folder).select("user_id", "bin", r6("envelope").alias("envelope"), r6("activity").alias("activity"))


@cat.query(
    "g13_binned_audio",
    f"WITH {GRID_SQL} SELECT user_id, bin, round(CASE WHEN c >= 1.8 THEN t / c END, 6) AS transition FROM t3",
)
def transitions(spark, folder):
    return audio(spark, folder).select("user_id", "bin", r6("transition").alias("transition"))


@cat.query(
    "a19_speech_threshold",
    f"""WITH {GRID_SQL} SELECT user_id, count(env) AS finite_bins, round(CASE WHEN count(env) >= 20 THEN quantile_cont(env, 0.15) END, 6) AS noise_floor,
 round(CASE WHEN count(env) >= 20 THEN quantile_cont(env, 0.15) + least(18, greatest(6, 0.30 * greatest(0, quantile_cont(env, 0.95) - quantile_cont(env, 0.15)))) END, 6) AS speech_threshold FROM ev GROUP BY 1""",
)
def speech(spark, folder):
    t = sg.speech_threshold(audio(spark, folder), ["user_id"], 20.0)
    return t.select("user_id", "finite_bins", r6("noise_floor").alias("noise_floor"), r6("speech_threshold").alias("speech_threshold"))


MASK_SQL = f"""{GRID_SQL}, th AS (SELECT user_id, CASE WHEN count(env) >= 25 THEN quantile_cont(env, 0.15) + least(18, greatest(6, 0.30 * greatest(0, quantile_cont(env, 0.95) - quantile_cont(env, 0.15)))) END AS th FROM ev GROUP BY 1),
m0 AS (SELECT user_id, bin, env, coalesce(env >= th, false) AS m FROM ev JOIN th USING (user_id)),
r0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bin) - row_number() OVER (PARTITION BY user_id, m ORDER BY bin) AS g FROM m0),
z0 AS (SELECT user_id, m, g, count(*) AS n, min(bin) AS a, max(bin) AS b FROM r0 GROUP BY ALL),
e0 AS (SELECT user_id, min(bin) AS lo, max(bin) AS hi FROM m0 GROUP BY 1),
m1 AS (SELECT r0.user_id, bin, env, r0.m OR (NOT r0.m AND n <= 2 AND a > lo AND b < hi) AS m FROM r0 JOIN z0 USING (user_id, m, g) JOIN e0 USING (user_id)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bin) - row_number() OVER (PARTITION BY user_id, m ORDER BY bin) AS g FROM m1),
z1 AS (SELECT user_id, m, g, count(*) AS n FROM r1 GROUP BY ALL)
SELECT user_id, bin, r1.m AND n >= 2 AND env IS NOT NULL AS speech FROM r1 JOIN z1 USING (user_id, m, g)"""


@cat.query("g13_speech_mask", f"WITH {MASK_SQL}")
def mask(spark, folder):
    # Two run rewrites read the bins several times: compute them once.
    made = cut_lineage(audio(spark, folder))
    m = sg.speech_mask(made, ["user_id"], 25.0, Slicing(width=100_000))
    return m.select("user_id", "bin", "speech")
