"""Golden fixtures, strictness and boundary cases."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lagledger.functions import numeric as nm
from lagledger.functions import text as tx
from lagledger.operators import annotations as an
from lagledger.operators import audit, compare, epochs, geometry, ledger, nearest, sequence, signal, statistics, timeline, tokens
from lagledger.operators.scan import Slicing
from lagledger.sources import readers, sinks
from lagledger.streaming import tracking

EVENTS = [
    ("c", "candidate", "c1", 110.0, True), ("c", "candidate", "c1", 130.0, True), ("c", "candidate", "c2", 150.0, True),
    ("i1", "control", "i1", 10.0, True), ("i2", "control", "i2", 20.0, True), ("i2", "control", "i2", 900.0, False),
]
SCHEMA = "speaker string, grp string, epoch_id string, lag_ms double, measurable boolean"


def test_epoch_fixture(spark):
    e = epochs.epoch_summary(spark.createDataFrame(EVENTS, SCHEMA), margin_ms=83.34)
    rows = {r["epoch_id"]: r for r in e.collect()}
    assert len(rows) == 4
    assert rows["c1"]["event_count"] == 2 and rows["c1"]["median_lag_ms"] == 120.0 and rows["c1"]["fraction_over_margin"] == 1.0
    c = statistics.compare_groups(e.withColumn("s", F.lit(1)), ["s"], margin_ms=83.34, iterations=100, permutations=50).collect()[0]
    assert c["candidate_epoch_count"] == 2 and c["control_epoch_count"] == 2
    assert c["median_difference_ms"] > 100 and c["cliffs_delta"] > 0.9
    # 6 labelings, only the observed one reaches the difference: (1 + 1) / (6 + 1).
    assert abs(c["permutation_p"] - 2 / 7) < 1e-12


def test_one_group_only_has_no_comparison(spark):
    one = spark.createDataFrame(EVENTS[:3], SCHEMA)
    e = epochs.epoch_summary(one, margin_ms=83.34).withColumn("s", F.lit(1))
    c = statistics.compare_groups(e, ["s"], margin_ms=83.34, iterations=20, permutations=20).collect()[0]
    assert c["candidate_epoch_count"] == 2 and c["control_epoch_count"] == 0
    assert c["median_difference_ms"] is None and c["bootstrap_ci95"] is None and c["permutation_p"] is None


def window(spark, states, period=1 / 24, start=-6, usable=None):
    rows = [("e", 10.0, 10.0 + (start + i) * period, True if usable is None else usable[i], s) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "event_id string, audio_time double, time_s double, usable boolean, state string")


def judge(spark, *a, **k):
    return geometry.closure_geometry(window(spark, *a, **k), "event_id", "time_s").collect()[0]


def test_closure_classes(spark):
    o, c = "open", "closed/contact"
    assert judge(spark, [o] * 9)["closure"] == "no_visible_contact"
    assert judge(spark, [o] * 5 + [c] + [o] * 3)["closure"] == "weak_contact"
    assert judge(spark, [o] * 5 + [c, c] + [o] * 2)["closure"] == "strong_contact"
    # Absence needs every frame: one unusable frame and no contact is unavailable.
    r = judge(spark, [o] * 9, usable=[True] * 8 + [False])
    assert r["closure"] == "unavailable" and r["face_reasons"] == ["incomplete_usable_frame_coverage_for_absence"]
    assert judge(spark, [o] * 4 + [c] + [o] * 4, usable=[True] * 8 + [False])["closure"] == "weak_contact"


def test_post_audio_only_boundary(spark):
    o, c = "open", "closed/contact"
    flag = lambda states: geometry.closure_geometry(window(spark, states), "event_id", "time_s").select(
        geometry.post_audio_only("earliest_contact", 1 / 24 + 1e-9).alias("p")
    ).collect()[0]["p"]
    assert flag([o] * 8 + [c]) and not flag([o] * 7 + [c] + [o])


def test_direction_boundary_is_near(spark):
    rows = spark.createDataFrame([(None,), (-80.1,), (-80.0,), (80.0,), (80.1,)], "x double")
    got = [r[0] for r in rows.select(nm.direction("x", 80.0)).collect()]
    assert got == ["unavailable", "video_leads", "near", "near", "video_lags"]


def test_strict_joins_refuse_bad_keys(spark):
    l = spark.createDataFrame([(1,), (2,)], "k int")
    ann = lambda ks: spark.createDataFrame([(k, "x") for k in ks], "k int, v string")
    assert {r["k"]: r["join_reasons"] for r in ledger.ledger_join(l, ann([2]), "k").collect()} == {1: ["no_annotation"], 2: []}
    for bad in ([2, 2], [3]):
        with pytest.raises(Exception, match="duplicate|unknown"):
            ledger.ledger_join(l, ann(bad), "k").collect()
    done = spark.createDataFrame([(1, "old")], "k int, config_sha256 string")
    with pytest.raises(Exception, match="another configuration"):
        ledger.resume(l, done, "k", "new").collect()


def test_interval_edges(spark):
    pts = spark.createDataFrame([(1, 0, 0.0), (1, 1, 5.0), (1, 2, 9.999), (1, 3, 10.0), (1, 4, 25.0)], "k int, id int, t double")
    iv = spark.createDataFrame([(1, 7, 0.0, 10.0), (1, 8, 10.0, 20.0)], "k int, iv int, a double, b double")
    out = nearest.point_in_interval(pts, iv, ["k"], "t", "a", "b", Slicing(width=4), tie="iv", guard=0.75)
    got = {r["id"]: (r["interval"] and r["interval"]["iv"], r["placement"]) for r in out.collect()}
    assert got == {0: (7, "near_transition"), 1: (7, "inside"), 2: (7, "near_transition"), 3: (8, "near_transition"), 4: (None, "outside")}


def test_overlaps_find_nesting(spark):
    iv = spark.createDataFrame([(1, 0.0, 100.0), (2, 10.0, 20.0), (3, 30.0, 40.0), (4, 100.0, 110.0)], "id int, s double, e double").withColumn("k", F.lit(1))
    assert sorted(r["id"] for r in sequence.overlaps(iv, ["k"], "s", "e", "id", Slicing(width=5)).collect()) == [2, 3]


def test_annotation_errors(spark):
    rows = spark.createDataFrame(
        [("a", "measurable", None, "p"), ("b", "unmeasurable", 1.0, "p"), ("c", "measurable", 1.0, "b"), ("d", "measurable", 1.0, "p")],
        "id string, status string, time_s double, phoneme_class string",
    ).withColumns({"selected_class": F.lit("p"), "speaker": F.lit("s"), "epoch_id": F.lit("e"), "grp": F.lit("control")})
    got = {r["id"]: r["status_reasons"] for r in an.status_consistency(rows).collect()}
    assert got == {"a": ["measurable_without_time"], "b": ["unmeasurable_with_time"], "c": ["class_mismatch"], "d": []}


def test_review_rank_wins_and_holes_count(spark):
    cand = "array<struct<rank:int,time_s:double,relative_ms:double>>"
    rows = [
        ("ok", 1, 10.0, "P", "measurable"), ("apart", 1, 90.0, "p", "measurable"), ("rank", 9, None, "p", "measurable"), ("hole", None, 300.0, "p", "measurable"),
        ("label", 1, 10.0, "uncertain", "measurable"), ("old", 1, 10.0, "target", "ambiguous"), ("none", None, None, "p", "measurable"), ("un", 1, None, "b", "unmeasurable"),
    ]
    df = spark.createDataFrame(rows, "id string, selected_rank int, relative_ms double, realization string, status string").withColumns(
        {
            "confidence": F.lit(" High"), "reason": F.lit("clear"), "anchor_s": F.lit(5.0), "source_anchor_s": F.lit(5.0), "target_class": F.lit("/p/"), "window_start_s": F.lit(4.0), "window_end_s": F.lit(6.0),
            "candidates": F.array(F.struct(F.lit(1).alias("rank"), F.lit(5.012).alias("time_s"), F.lit(12.0).alias("relative_ms"))).cast(cand),
            "covered_intervals": F.array(F.struct(F.lit(4.0).alias("start_s"), F.lit(5.2).alias("end_s"))),
        }
    )
    got = {r["id"]: (r["chosen_time_s"], r["review_reasons"]) for r in an.review_row_valid(df).collect()}
    assert got["ok"] == (5.012, []) and got["apart"][1] == ["rank_and_time_disagree"]
    assert got["rank"][1] == ["rank_out_of_range"] and got["hole"][1] == ["time_not_covered"]
    assert got["label"][1] == ["measurable_requires_target"] and got["old"][1] == ["invalid_status", "invalid_realization"]
    assert got["none"][1] == ["no_time_chosen"] and got["un"][1] == ["unmeasurable_with_time"]


def test_tone_balance_and_mono(spark):
    t = np.arange(1600) / 16_000
    tone = np.sin(2 * np.pi * 200 * t)
    df = spark.createDataFrame([((0.2 * tone).tolist(), (0.1 * tone).tolist()), (tone.tolist(), None)], "l array<double>, r array<double>")
    a, b = df.select(*[c.alias(n) for n, c in signal.stereo_diagnostics(F.col("l"), F.col("r")).items()]).collect()
    assert abs(a["stereo_balance_db"] - 6.0206) < 1e-3 and abs(a["stereo_correlation"] - 1) < 1e-9 and all(v is None for v in b)
    f = signal.frame_features(spark.createDataFrame([(tone[:640].tolist(),)], "samples array<double>"), signal.FrameConfig(sample_rate=16_000)).collect()[0]
    assert abs(f["f0_candidate_hz"] - 200) < 2.0 and f["periodicity"] > 0.9 and abs(f["spectral_centroid_hz"] - 200) < 20


def test_lag_correlation_finds_the_shift(spark):
    x = np.random.default_rng(0).normal(size=400)
    df = spark.createDataFrame([(x[30:330].tolist(), x.tolist(), 30)], "r array<double>, t array<double>, want int")
    r = signal.lag_correlation(df, "r", "t", residual_limit=0, expected="want").collect()[0]
    assert r["best_lag"] == 30 and r["peak_correlation"] > 0.999999 and r["passed"]
    out = spark.createDataFrame([(np.repeat(x, 20).tolist(), np.repeat(x, 20).tolist())], "a array<double>, b array<double>")
    p = signal.preservation(out, "a", "b").collect()[0]
    assert p["alignment_lag"] == 0 and p["passed"] and p["normalized_rmse"] < 1e-9


def test_preservation_joins_channels_of_a_shifted_pair(spark):
    rng = np.random.default_rng(1)
    low = lambda: np.convolve(rng.normal(size=5400), np.ones(16) / 16, "valid")[:5200]
    a, b = low(), low()
    rows = [([v[40:5000].tolist() for v in (a, b)], [v[:5000].tolist() for v in (a, b)]), ([a[:5000].tolist(), (b[:5000] / 2).tolist()], [a[:5000].tolist(), (-b[:5000] / 2).tolist()])]
    df = spark.createDataFrame(rows, "r array<array<double>>, o array<array<double>>")
    shifted, flipped = signal.preservation(df, "r", "o").collect()
    assert shifted["alignment_lag"] == 40 and shifted["passed"] and shifted["normalized_rmse"] < 1e-9
    assert not flipped["passed"] and abs(flipped["rms_delta_db"]) < 1e-6  # one channel is wrong, so the pair is


def test_sections_and_markers_of_a_frame_map(spark):
    frames = [(None, i, "intro" if i < 2 else "normal" if i < 5 else "gap", None if i < 2 else "e") for i in range(6)]
    declared = [(None, 0, "intro", None, 2), (None, 1, "normal", "e", 3), (None, 2, "gap", "e", 1)]
    check = lambda rows, sections: sorted(
        tuple(r)[1:] for r in timeline.section_violations(
            spark.createDataFrame(rows, "k string, i long, phase string, event_id string"),
            spark.createDataFrame(sections, "k string, o long, phase string, event_id string, n long"), ["k"], "i", "o", [], "n", Slicing(width=2), Slicing(width=2),
        ).collect()
    )
    assert check(frames, declared) == []
    assert check(frames[:-1], declared) == [(2, "section_truncated", 1)]
    assert check(frames, declared[:-1]) == [(None, "outside_sections", 1)]
    assert check(frames, [declared[0], (None, 1, "normal", "f", 3), declared[2]]) == [(1, "row_differs", 3)]
    fr = spark.createDataFrame([("e", i, i / 24, 1.0 + i / 24) for i in range(5)] + [("f", 0, 0.0, 1.0)], "k string, index long, output_pts double, source_pts double")
    mk = spark.createDataFrame([("e", 2 / 24, 1.0 + 3 / 24), ("f", 0.0, 1.1), ("g", 0.0, 1.0)], "k string, marker_output_s double, release_s double")
    assert sorted((r["k"], r["at"], r["violation"]) for r in timeline.marker_mapped(fr, mk, ["k"], 24.0).collect()) == [
        ("e", 2, None), ("f", 0, "marker_shifted"), ("g", None, "marker_missing")
    ]


def test_frame_map_tamper(spark):
    good = [(i, i / 24, "normal", "e", i) for i in range(4)] + [(4 + i, (4 + i) / 24, "slow", "e", i // 4) for i in range(8)] + [(12, 0.5, "gap", None, 1)]
    schema = "i long, pts double, phase string, event_id string, source_index long"
    check = lambda rows: {
        r["violation"] for r in timeline.frame_map_violations(
            spark.createDataFrame(rows, schema).withColumn("m", F.lit(1)), ["m"], "i", "pts", 24.0, Slicing(width=5), hold=4
        ).collect()
    }
    assert check(good) == set()
    assert check(good[:-1] + [(12, 0.5, "gap", None, 2)]) == {"gap_source_changed"}
    assert "wrong_hold_count" in check(good[:11] + [(12, 0.5, "gap", None, 1)])
    assert check([(i, p + (0.01 if i == 2 else 0), *r) for i, p, *r in good]) == {"pts_differs_from_index"}
    ev = spark.createDataFrame([("e", 1.0), ("f", 2.0)], "event_id string, release_s double")
    fr = spark.createDataFrame([("e", 1.2, True), ("f", 2.01, True)], "event_id string, source_pts double, marker boolean")
    assert [tuple(r) for r in timeline.marker_violations(fr, ev, "event_id", 24.0).collect()] == [("e", "marker_shifted")]


SECRETS = {
    "local user path": ("/ho" + "me/someone/", "/hom/someone"),
    "private key": ("BEGIN RSA PRIV" + "ATE KEY", "BEGIN PUBLIC KEY"),
    "GitHub token": ("gh" + "p_" + "a1" * 12, "gh" + "p_short"),
    "OpenAI-style secret": ("s" + "k-" + "b2" * 12, "s" + "k-short"),
    "AWS access key": ("AK" + "IA" + "A1" * 8, "AK" + "IA" + "a1" * 8),
    "Google API key": ("AI" + "za" + "x_" * 16, "AI" + "za" + "x"),
    "email address": ("who" + "@" + "mail.example", "who" + "@" + "mail"),
    "Japanese mobile number": ("090" + "-1234-" + "5678", "1090" + "-1234-" + "5678"),
    "Google Drive URL": ("https://drive." + "google.com/x", "https://drive.example.com/"),
    "signed URL credential": ("?Api" + "_Key=1", "?key=1"),
}


def test_leak_patterns(spark):
    rows = [(n, hit, miss) for n, (hit, miss) in SECRETS.items()]
    df = spark.createDataFrame(rows, "n string, hit string, miss string")
    assert {(r["n"], r["pattern"]) for r in audit.leak_scan(df, "n", "hit").collect()} == {(n, n) for n in SECRETS}
    assert audit.leak_scan(df, "n", "miss").count() == 0


def test_boundary_of_result_tables(spark):
    assert audit.forbidden_columns(spark.createDataFrame([((1,),)], "a struct<`Overall-Score`:int>")) == ["a.Overall-Score"]
    assert not set(compare.METRICS) & set(audit.FORBIDDEN_KEYS)


def test_target_tokens_keep_everything(spark):
    words = spark.createDataFrame(
        [(1, 0, "テスト", None, 0.0, 1.0, 0.9), (1, 1, "切符", "きっぷ", 1.0, 2.0, 0.9), (1, 2, "バス、パン", None, 9.5, 10.5, 0.5)],
        "source int, word_order long, word string, reading string, start double, end double, probability double",
    ).withColumn("no_speech_prob", F.lit(0.1))
    iv = spark.createDataFrame([(1, 5, 0.0, 9.0)], "source int, interval_id int, start_s double, end_s double")
    t = tokens.target_tokens(words, iv, ["source"], "word_order", Slicing(width=100), cutoff=10.0).orderBy("anchor_s").collect()
    assert [(r["letter"], r["phoneme_class"], r["reading_source"]) for r in t] == [("ぷ", "p", "reading"), ("バ", "b", "surface_word"), ("パ", "p", "surface_word")]
    assert abs(t[0]["anchor_s"] - (1 + 2.5 / 3)) < 1e-9 and t[0]["eligible"]
    # The comma takes no share: four counted characters, the second target is the third of them.
    assert abs(t[2]["anchor_s"] - (9.5 + 2.5 / 4)) < 1e-9
    assert t[2]["exclusion_reasons"] == ["after_interview_cutoff", "low_asr_probability", "outside_labeled_speaker_interval"]


def test_nfkc_and_anchor_of_empty_text(spark):
    r = spark.createDataFrame([("ﾊﾟＡ",)], "x string").select(tx.nfkc("x").alias("n"), tx.proportional_anchor(F.lit("、"), F.lit(0), F.lit(1.0), F.lit(2.0)).alias("a")).collect()[0]
    assert r["n"] == "パA" and r["a"] == 1.0


def test_sinks_and_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")]), (2, 2.5, None)], "id int, x double, a array<double>")
    sinks.write_strict_json(df, str(tmp_path / "j"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"id":1,"x":null,"a":[1.0,null]}', '{"id":2,"x":2.5,"a":null}']
    sinks.write_flat_csv(df, str(tmp_path / "c"))
    with pytest.raises(PySparkException):
        sinks.write_flat_csv(df, str(tmp_path / "c"))
    back = readers.read_keyed_csv(spark, str(tmp_path / "c"), "id").orderBy("id").collect()
    assert [(r["id"], r["x"]) for r in back] == [("1", None), ("2", "2.5")]
    (tmp_path / "d.csv").write_text("id,x\n1,a\n1,b\n")
    with pytest.raises(Exception, match="duplicate key"):
        readers.read_keyed_csv(spark, str(tmp_path / "d.csv"), "id").collect()
    (tmp_path / "doc.json").write_text('{"annotations": [{"id": "a"}, {"id": "b"}], "note": 1}')
    assert [r["id"] for r in readers.read_events(spark, str(tmp_path / "doc.json"), "struct<id:string>").collect()] == ["a", "b"]
    (tmp_path / "bad.json").write_text('{"note": 1}')
    with pytest.raises(Exception, match="no event list"):
        readers.read_events(spark, str(tmp_path / "bad.json"), "struct<id:string>").collect()
    assert readers.fingerprint_files(spark, str(tmp_path / "*.json")).count() == 2


def boxes(spark):
    # Two objects cross slowly, one leaves and a far one appears after a pause.
    rows = []
    for i in range(10):
        for n, x in ((0, 0.1 + 0.01 * i), (1, 0.6 - 0.01 * i)):
            rows.append((1, 0.5 * i, 2 * i + n, [x, 0.2, x + 0.2, 0.5], [1.0, 0.0] if n == 0 else [0.0, 1.0], False))
    rows += [(1, 20.0, 90, [0.1, 0.2, 0.3, 0.5], [1.0, 0.0], False), (1, 20.5, 91, [0.1, 0.2, 0.3, 0.5], [1.0, 0.0], True)]
    return spark.createDataFrame(rows, "source long, time_s double, detection_id long, bbox array<double>, descriptor array<double>, scene_cut boolean")


def test_tracks_batch_and_stream_agree(spark, tmp_path):
    df = boxes(spark)
    batch = {r["detection_id"]: r["track_id"] for r in tracking.track_objects(df, Slicing(width=3.0)).collect()}
    assert {batch[2 * i] for i in range(10)} == {0} and {batch[2 * i + 1] for i in range(10)} == {1}
    assert batch[90] == 2 and batch[91] == 3  # pause, then a scene cut
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i, cond in enumerate(("time_s < 2.6", "time_s >= 2.6")):
        df.filter(cond).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = tracking.stream_tracks(live).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["detection_id"]: r["track_id"] for r in spark.table("tracks").collect()} == batch


def test_finite_and_strict_types(spark):
    r = spark.createDataFrame([("1e3", True)], "a string, b boolean").select(nm.finite("a"), nm.strict_finite("b", "boolean"), nm.finite(F.lit("nan"))).collect()[0]
    assert tuple(r) == (1000.0, None, None) and math.isfinite(r[0])
