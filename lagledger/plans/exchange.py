"""Sources, sinks, streaming and frame-map queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lagledger.functions.numeric import micros, r6
from lagledger.operators import timeline as tl
from lagledger.operators.rules import reasons
from lagledger.plans.catalogue import Catalogue
from lagledger.plans.standins import CLIPS_SQL, DAY_US, E_SQL, HOUR_US, Slicing, clips, stream, table
from lagledger.session import shared_folder, tasks_for
from lagledger.sources import readers, sinks
from lagledger.streaming import bins, gaps, resume, tracking

cat = Catalogue()


def fresh(spark, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@cat.query("s1_read_events", "SELECT conv_id * 1000 + turn AS doc, 0 AS position, role, length(text) AS n FROM conversations")
def documents(spark, folder):
    c = table(spark, folder, "conversations")
    one = F.array(F.struct("role", F.length("text").alias("n")))
    raw = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(one.alias("events")))).otherwise(F.to_json(F.struct(one.alias("annotations"))))
    d = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), raw.alias("raw"))
    return readers.events_of(d, "raw", "struct<role:string,n:bigint>", ident="doc")


@cat.query("s2_read_keyed_csv", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders")
def keyed(spark, folder):
    path = fresh(spark, "csv")
    table(spark, folder, "orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(path)
    return readers.read_keyed_csv(spark, path, "o_orderkey", "o_orderkey string, o_orderstatus string")


@cat.query(
    "s4_clip_manifest",
    """WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS k FROM customer GROUP BY 1)
SELECT 'c' || c_custkey AS clip_id, 'n' || c_nationkey AS group_id, k AS group_order, ['#0072B2', '#D55E00', '#009E73', '#CC79A7', '#E69F00', '#56B4E9', '#6A3D9A', '#A6761D'][k % 8 + 1] AS display_color_hex,
 CASE WHEN c_acctbal < 0 THEN 'invalid interval' ELSE '' END AS reasons FROM customer JOIN g USING (c_nationkey)""",
)
def manifest(spark, folder):
    k = F.col("c_custkey")
    named = F.concat(F.lit("c"), k.cast("string"))
    c = table(spark, folder, "customer").select(
        k.alias("pos"), F.when(k % 2 == 0, named).alias("clip_id"), F.when(k % 2 == 1, named).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("group"),
        F.col("c_name").alias("label"), F.col("c_acctbal").alias("start_s"),
    )
    m = readers.normalize_manifest(c, None, "pos", "common.wav")
    return m.select("clip_id", "group_id", "group_order", "display_color_hex", F.concat_ws(",", "manifest_reasons").alias("reasons"))


@cat.query("s5_fingerprint_files")
def fingerprints(spark, folder):
    return readers.fingerprint_files(spark, f"{folder}/*.parquet").select("name", "size", "sha256")


def nested_ledger(spark, folder):
    e = stream(spark, folder)
    odd = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select(
        "event_id", F.struct(F.col("event_type").alias("kind"), odd.alias("level")).alias("measurement"),
        reasons((F.col("value") < 10, "weak"), (F.col("user_id") % 2 == 0, "even")).alias("exclusion_reasons"),
    )


WEAK = "CASE WHEN value < 10 THEN 'weak' END, CASE WHEN user_id % 2 = 0 THEN 'even' END"


@cat.query(
    "s6_flat_csv",
    f"""WITH e AS ({E_SQL}) SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS level,
 '[' || concat_ws(',', CASE WHEN value < 10 THEN '"weak"' END, CASE WHEN user_id % 2 = 0 THEN '"even"' END) || ']' AS exclusion_reasons FROM e""",
)
def flat_csv(spark, folder):
    path = fresh(spark, "flat")
    n = nested_ledger(spark, folder)
    sinks.write_flat_csv(n.select("event_id", F.col("measurement.level").alias("level"), "exclusion_reasons"), path)
    return spark.read.option("header", True).option("escape", '"').schema("event_id string, level double, exclusion_reasons string").csv(path)


@cat.query("s7_strict_json", f"WITH e AS ({E_SQL}) SELECT event_id, event_type AS kind, CASE WHEN event_id % 5 <> 0 THEN value END AS level FROM e")
def strict_json(spark, folder):
    path = fresh(spark, "json")
    sinks.write_strict_json(nested_ledger(spark, folder), path)
    back = spark.read.schema("event_id bigint, measurement struct<kind:string,level:double>").json(path)
    return back.select("event_id", "measurement.kind", "measurement.level")


@cat.query("s8_flatten_event", f"WITH e AS ({E_SQL}) SELECT event_id, event_type AS measurement_kind, concat_ws(',', {WEAK}) AS reasons FROM e")
def flattened(spark, folder):
    n = nested_ledger(spark, folder)
    f = n.select(*sinks.flatten_event(n))
    return f.select("event_id", "measurement_kind", F.concat_ws(",", "exclusion_reasons").alias("reasons"))


@cat.query("s9_write_new", "SELECT o_orderkey, o_custkey FROM orders")
def written(spark, folder):
    path = fresh(spark, "new")
    sinks.write_new(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), path)
    return spark.read.schema("o_orderkey bigint, o_custkey bigint").parquet(path)


@cat.query("s10_frame_table", f"WITH v AS ({CLIPS_SQL}) SELECT clip_id, frame_index, group_id FROM v")
def frame_table(spark, folder):
    path = fresh(spark, "frames")
    sinks.write_frame_table(clips(spark, folder).select("clip_id", "frame_index", "group_id"), path)
    return spark.read.schema("clip_id bigint, frame_index bigint, group_id int").parquet(path)


@cat.query(
    "s10_clip_table",
    f"""WITH v AS ({CLIPS_SQL}), s AS (SELECT clip_id, group_id, unnest(samples) AS x FROM v)
SELECT clip_id, group_id, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms FROM s GROUP BY ALL""",
)
def clip_table(spark, folder):
    path = fresh(spark, "clips")
    x = clips(spark, folder).select("clip_id", "group_id", F.explode("samples").alias("x"))
    own = x.groupBy("clip_id", "group_id").agg(r6(F.max(F.abs("x"))).alias("peak"), r6(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms"))
    sinks.write_clip_table(own, path)
    return spark.read.schema("clip_id bigint, peak double, rms double, group_id int").parquet(path)


@cat.query(
    "s10_group_table",
    """SELECT c_nationkey AS group_id, m.metric, count(*) AS clips, round(median(m.value), 4) AS median FROM (SELECT c_nationkey, unnest([{metric: 'balance', value: c_acctbal::DOUBLE}, {metric: 'name_length', value: length(c_name)::DOUBLE}]) AS m FROM customer) GROUP BY ALL""",
)
def group_table(spark, folder):
    path = fresh(spark, "groups")
    metric = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    c = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("group_id"), F.inline(F.array(metric("balance", F.col("c_acctbal")), metric("name_length", F.length("c_name"))))
    )
    sinks.write_group_table(c.groupBy("group_id", "metric").agg(F.count("value").alias("clips"), F.round(F.median("value"), 4).alias("median")), path)
    return spark.read.parquet(path)


@cat.query(
    "r1_stream_bins",
    f"""WITH e AS ({E_SQL}), b AS (SELECT user_id, t // {6 * HOUR_US} * {6 * HOUR_US} AS bin_start_us, sum(value * value) AS e, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, bin_start_us, round(e, 4) AS energy_sum, n AS sample_count FROM b WHERE bin_start_us + {6 * HOUR_US} <= (SELECT max(t) // 1000 * 1000 FROM e) - {DAY_US}""",
)
def streamed_bins(spark, folder):
    """Bins whose end the watermark has passed; the rest stay in state for later data."""
    schema = table(spark, folder, "events").schema
    live = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    out = bins.stream_bins(live, "user_id", "ts", "value", width="6 hours", delay="1 day")
    path = fresh(spark, "bins")
    bins.run_to_table(out, path, fresh(spark, "bins-checkpoint"))
    back = spark.read.schema("user_id bigint, bin_start_us bigint, energy_sum double, sample_count bigint, peak double").parquet(path)
    return back.select("user_id", "bin_start_us", F.round("energy_sum", 4).alias("energy_sum"), "sample_count")


BIN = 6 * HOUR_US
LATE_SQL = f"""e AS ({E_SQL}), m AS (SELECT max(t) FILTER (event_id % 10 <> 0) // 1000 * 1000 - {DAY_US} AS first, max(t) // 1000 * 1000 - {DAY_US} AS last FROM e),
x AS (SELECT user_id, t // {BIN} * {BIN} AS b, value, event_id % 10 = 0 AND t // {BIN} * {BIN} + {BIN} <= first AS late, last FROM e, m),
k AS (SELECT user_id, b, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS l, coalesce(sum(value * value) FILTER (NOT late), 0) AS e FROM x WHERE b + {BIN} <= last GROUP BY ALL),
s AS (SELECT k.user_id, k.b, k.n, k.l, k.e + 0.75 * (coalesce(p.e, 0) + coalesce(q.e, 0)) AS es, k.n + 0.75 * (coalesce(p.n, 0) + coalesce(q.n, 0)) AS ns
 FROM k LEFT JOIN k p ON p.user_id = k.user_id AND p.b = k.b - {BIN} LEFT JOIN k q ON q.user_id = k.user_id AND q.b = k.b + {BIN})"""


@cat.query(
    "r1_late_and_smoothed_bins",
    f"""WITH {LATE_SQL} SELECT user_id, b AS bin_start_us, n AS sample_count, l AS late_count, CASE WHEN ns > 0 THEN round(10 * log10(greatest(es / ns, 1e-14)), 6) END AS level_db FROM s""",
)
def late_bins(spark, folder):
    """A stream that stops and goes on with every tenth row, most of them behind the watermark by then."""
    events = table(spark, folder, "events")
    inbox, out, arrived = (fresh(spark, n) for n in ("inbox", "bins", "arrivals"))
    marks = [fresh(spark, "checkpoint") for _ in range(2)]
    for part, mode in (("event_id % 10 != 0", "error"), ("event_id % 10 = 0", "append")):
        rows = events.filter(part).select("user_id", "ts", "value")
        rows.write.mode(mode).parquet(inbox)
        live = spark.readStream.schema(rows.schema).parquet(inbox)
        bins.run_to_table(bins.stream_bins(live, "user_id", "ts", "value", width="6 hours", delay="1 day"), out, marks[0])
        bins.count_arrivals(live, "user_id", "ts", "value", arrived, marks[1], width="6 hours")
    emitted = spark.read.schema("user_id bigint, bin_start_us bigint, energy_sum double, sample_count bigint, peak double").parquet(out)
    seen = spark.read.schema("user_id bigint, bin_start_us bigint, arrived bigint, latest_us bigint").parquet(arrived)
    whole = bins.smooth_levels(bins.late_counts(emitted, seen, "user_id", width_us=BIN, delay_us=DAY_US), "user_id", BIN, [0.75, 1.0, 0.75])
    return whole.select("user_id", "bin_start_us", "sample_count", "late_count", r6("level_db").alias("level_db"))


def doubled_or_poisoned():
    """The work per event: twice the value; an event whose id is a multiple of 97 cannot be processed."""
    import pandas as pd

    def process(frame):
        if (frame["event_id"] % 97 == 0).any():
            raise ValueError("poisoned event")
        return pd.DataFrame({"event_id": frame["event_id"], "doubled": frame["value"] * 2})

    return process


@cat.query(
    "r4_resume_stream",
    """SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'processing_error' ELSE 'done' END AS status, CASE WHEN event_id % 97 <> 0 THEN round(value * 2, 4) END AS doubled,
 CASE WHEN event_id % 97 = 0 THEN 'ValueError: poisoned event' END AS error, 1::BIGINT AS attempts, true AS other_refused, event_id % 2 = 1 AS after_restart FROM events""",
)
def resumed_stream(spark, folder):
    """A file stream that ends after the even events and goes on, from its checkpoint, with the odd ones and repeats of every tenth.

    Then another configuration asks for the same folder and is refused.
    """
    inbox, out, checkpoint = (fresh(spark, n) for n in ("inbox", "results", "resume-checkpoint"))
    e = table(spark, folder, "events").select("event_id", "value")
    made = e.select("event_id", F.col("value").alias("doubled")).schema

    def run(fingerprint):
        live = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 8).parquet(inbox)
        return resume.resume_stream(live, "event_id", out, checkpoint, fingerprint, doubled_or_poisoned(), made)[1]

    e.filter("event_id % 2 = 0").write.parquet(inbox)
    before = run("first")
    last = before.agg(F.max("batch_id")).first()[0]
    e.filter("event_id % 2 = 1 OR event_id % 10 = 0").write.mode("append").parquet(inbox)
    results = run("first")
    try:
        run("second")
        refused = False
    except resume.ConfigurationMismatch:
        refused = True
    attempts = results.groupBy("event_id").agg(
        F.max("status").alias("status"), F.round(F.max("doubled"), 4).alias("doubled"), F.max("error").alias("error"), F.count(F.lit(1)).alias("attempts"),
        F.max("batch_id").alias("_batch"),
    )
    return attempts.withColumn("other_refused", F.lit(refused)).withColumn("after_restart", F.col("_batch") > F.lit(-1 if last is None else last)).drop("_batch")


@cat.query(
    "r2_stream_gaps",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch_us(ts) - CASE WHEN event_id % 13 = 0 THEN {30 * HOUR_US} ELSE 0 END END AS s,
 floor(value * 1000)::BIGINT * 600000 AS d FROM events),
w AS (SELECT user_id, event_id, n, NULL::BIGINT AS last_end, s, d, CASE WHEN s IS NOT NULL THEN s + d END AS hi, s AS eff, NULL::BIGINT AS was FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, w.hi, e.s, e.d, CASE WHEN e.s IS NULL THEN w.hi + e.d ELSE greatest(w.hi, e.s + e.d) END,
  CASE WHEN coalesce(e.s, w.hi) - w.hi < -1000 THEN least(w.hi, coalesce(e.s, w.hi) + e.d) ELSE coalesce(e.s, w.hi) END, w.eff FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, s IS NULL AS missing_pts, coalesce(s - last_end > 1000, false) AS gap, coalesce(s - last_end < -1000, false) AS overlap, coalesce(s < was, false) AS reversed FROM w""",
)
def streamed_gaps(spark, folder):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    schema = table(spark, folder, "events").schema
    live = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    t, e = micros("ts"), F.col("event_id")
    chunks = live.select(
        F.col("user_id").alias("source"), e.alias("chunk_id"), F.when(e % 11 != 0, t - F.when(e % 13 == 0, 30 * HOUR_US).otherwise(0)).alias("start"),
        (F.floor(F.col("value") * 1000) * 600_000).alias("duration"),
    )
    path = fresh(spark, "gaps")
    bins.run_to_table(gaps.stream_gaps(chunks, 1000), path, fresh(spark, "gaps-checkpoint"))
    back = spark.read.schema(gaps.OUTPUT).parquet(path)
    return back.select(F.col("chunk_id").alias("event_id"), "missing_pts", "gap", "overlap", "reversed")


def detections(spark, folder):
    """Frames of a label as detections: box from four samples, descriptor from eight."""
    s = F.col("samples")
    side = lambda x: F.abs(x) + 0.2
    return clips(spark, folder).select(
        F.col("group_id").cast("long").alias("source"), (F.floor(F.col("vec_id") / 20) * 0.5).alias("time_s"), F.col("vec_id").alias("detection_id"),
        F.array(s[0], s[1], s[0] + side(s[2]), s[1] + side(s[3])).alias("bbox"), F.transform(F.slice("samples", 5, 8), lambda x: x + 0.2).alias("descriptor"),
        (F.col("vec_id") % 200 == 0).alias("scene_cut"),
    )


@cat.query("r3_track_objects")
def tracks(spark, folder):
    return tracking.track_objects(detections(spark, folder), Slicing(width=60.0))


# Output frame map: per user, events in order; views play normally, the rest is held.
MAP_SQL = f"""m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN event_id % 501 = 0 THEN 1 ELSE 0 END AS i, CASE event_type WHEN 'view' THEN 'normal' WHEN 'click' THEN 'slow' ELSE 'gap' END AS phase, user_id AS event_id,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) // 4 AS source_index, event_id AS raw FROM events),
p AS (SELECT *, i / 24.0::DOUBLE + CASE WHEN raw % 997 = 0 THEN 0.01 ELSE 0 END AS pts FROM m),
n AS (SELECT *, lag(i) OVER w AS pi, lag(phase) OVER w AS pp, lag(source_index) OVER w AS ps FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i, raw))"""


@cat.query(
    "w22_verify_frame_map",
    f"""WITH {MAP_SQL}, v AS (SELECT user_id, i AS "at", 'index_not_contiguous' AS violation FROM n WHERE CASE WHEN pi IS NULL THEN i <> 0 ELSE i <> pi + 1 END
 UNION ALL SELECT user_id, i, 'pts_differs_from_index' FROM n WHERE abs(pts - i / 24.0::DOUBLE) > 1e-6 UNION ALL SELECT user_id, i, 'normal_source_not_consecutive' FROM n WHERE pp = phase AND phase = 'normal' AND source_index - ps <> 1
 UNION ALL SELECT user_id, i, 'slow_source_jumps' FROM n WHERE pp = phase AND phase = 'slow' AND source_index - ps NOT IN (0, 1) UNION ALL SELECT user_id, i, 'gap_source_changed' FROM n WHERE pi IS NOT NULL AND phase = 'gap' AND source_index <> ps
 UNION ALL SELECT user_id, min(i), 'wrong_hold_count' FROM n WHERE phase = 'slow' GROUP BY user_id, source_index HAVING count(*) <> 4)
SELECT user_id, "at", violation, count(*) AS n FROM v GROUP BY ALL""",
)
def frame_map(spark, folder):
    from lagledger.operators.scan import scan

    e = scan(table(spark, folder, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", Slicing(width=1_000_000), index="_k")
    raw = F.col("event_id")
    i = F.col("_k") + F.when(raw % 501 == 0, 1).otherwise(0)
    m = e.select(
        "user_id", i.alias("i"), F.when(F.col("event_type") == "view", "normal").when(F.col("event_type") == "click", "slow").otherwise("gap").alias("phase"),
        F.floor((F.col("_k") + 1) / 4).alias("source_index"), raw.alias("raw"),
    ).withColumn("event_id", F.col("user_id")).withColumn("pts", F.col("i") / 24.0 + F.when(F.col("raw") % 997 == 0, 0.01).otherwise(0.0))
    v = tl.frame_map_violations(m, ["user_id"], "i", "pts", 24.0, Slicing(width=100_000), hold=4, ties=["raw"])
    return v.groupBy("user_id", "at", "violation").agg(F.count(F.lit(1)).alias("n"))


# Frames of a supplier in the order of its lines; an order's lines are two sections, and some counts are declared wrongly.
SECTIONS_SQL = """l AS (SELECT l_suppkey AS k, l_orderkey AS e, CASE WHEN l_linenumber <= 3 THEN 'normal' ELSE 'slow' END AS phase, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem),
s AS (SELECT k, e, phase, count(*) + CASE WHEN e % 500 = 0 THEN 1 WHEN e % 700 = 1 THEN -1 ELSE 0 END AS n FROM l GROUP BY k, e, phase),
d AS (SELECT *, row_number() OVER w - 1 AS position, sum(n) OVER w - n AS lo, sum(n) OVER w AS hi FROM s WINDOW w AS (PARTITION BY k ORDER BY e, phase))"""


@cat.query(
    "w22_declared_sections",
    f"""WITH {SECTIONS_SQL}, g AS (SELECT l.k, l.i, d.position, l.phase = d.phase AND l.e = d.e AS fits FROM l LEFT JOIN d ON d.k = l.k AND l.i >= d.lo AND l.i < d.hi),
c AS (SELECT k, position, count(*) AS have, count(*) FILTER (NOT fits) AS other FROM g GROUP BY ALL)
SELECT k, position, 'outside_sections' AS violation, have AS frames FROM c WHERE position IS NULL UNION ALL SELECT k, position, 'row_differs', other FROM c WHERE position IS NOT NULL AND other > 0
UNION ALL SELECT d.k, d.position, 'section_truncated', (d.n - coalesce(c.have, 0))::BIGINT FROM d LEFT JOIN c ON c.k = d.k AND c.position = d.position WHERE d.n > coalesce(c.have, 0)""",
)
def declared_sections(spark, folder):
    from lagledger.operators.scan import dealt, scan

    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("event_id"), "l_linenumber", F.when(F.col("l_linenumber") <= 3, "normal").otherwise("slow").alias("phase")
    )
    tasks = tasks_for(spark, lines.count())
    by_order = Slicing(width=1_000_000, tasks=tasks)
    frames = scan(lines, ["k"], "event_id", by_order, ties=["l_linenumber"], index="i")
    e = F.col("event_id")
    wrong = F.when(e % 500 == 0, 1).when(e % 700 == 1, -1).otherwise(0)
    # The index is dense and sections start at different ones: a cell holds at most 200 000 rows, which need not be counted.
    by_index = Slicing(width=100_000, measured=True, tasks=tasks and 2 * tasks)
    sections = dealt(lines, ["k", "event_id", "phase"], tasks).groupBy("k", "event_id", "phase").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.col("n") + wrong)
    return tl.section_violations(frames, sections, ["k"], "i", "event_id", ["phase"], "n", by_order, by_index)


@cat.query(
    "w22_markers",
    """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber / 24.0::DOUBLE AS o, l_linenumber / 24.0::DOUBLE + l_discount::DOUBLE AS s FROM lineitem),
m AS (SELECT o_orderkey AS k, (o_custkey % 8) / 24.0::DOUBLE + 0.01 AS marker, (o_custkey % 8) / 24.0::DOUBLE AS release FROM orders),
n AS (SELECT f.k, f.i, f.s, row_number() OVER (PARTITION BY f.k ORDER BY abs(f.o - m.marker), f.i, f.s) AS rk FROM f JOIN m USING (k))
SELECT m.k, n.i AS "at", round(n.s, 6) AS source_pts, CASE WHEN n.k IS NULL THEN 'marker_missing' WHEN abs(n.s - m.release) > 1 / 24.0::DOUBLE + 0.001 THEN 'marker_shifted' END AS violation FROM m LEFT JOIN n ON n.k = m.k AND rk = 1""",
)
def markers(spark, folder):
    i = F.col("l_linenumber")
    frames = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), i.alias("index"), (i / F.lit(24.0)).alias("output_pts"), (i / F.lit(24.0) + F.col("l_discount").cast("double")).alias("source_pts")
    )
    base = (F.col("o_custkey") % 8) / F.lit(24.0)
    asked = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), (base + 0.01).alias("marker_output_s"), base.alias("release_s"))
    return tl.marker_mapped(frames, asked, ["k"], 24.0).select("k", "at", r6("source_pts").alias("source_pts"), "violation")


@cat.query(
    "j17_phase_lookup",
    """WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000)::BIGINT + 1 AS n FROM orders), c AS (SELECT *, sum(n + 10) OVER w - 10 AS f FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
s AS (SELECT o_custkey, o_orderkey, o_orderkey % 997 AS at FROM orders)
SELECT s.o_orderkey, c.o_orderkey AS clip, (s.at - (c.f - c.n))::BIGINT AS source_offset FROM s LEFT JOIN c ON c.o_custkey = s.o_custkey AND s.at >= c.f - c.n AND s.at < c.f""".replace(" AS at FROM", ' AS "at" FROM').replace("s.at", 's."at"'),
)
def phases(spark, folder):
    o = table(spark, folder, "orders")
    parts = o.select("o_custkey", "o_orderkey", (F.floor(F.col("o_totalprice") / 1000) + 1).alias("n"))
    timeline = tl.assemble_timeline(parts, ["o_custkey"], "o_orderkey", "n", Slicing(width=1_000_000), intro=0, gap=10, outro=0, frame=1)
    samples = o.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 997).alias("at"))
    p = tl.phase_lookup(samples, timeline, ["o_custkey"], "at", Slicing(width=100_000))
    inside = F.col("phase") == "clip"
    return p.select("o_orderkey", F.when(inside, F.col("clip")).alias("clip"), "source_offset")
