"""Resume on a stream: restarts, replays, other configurations, failing events."""

import pandas as pd
import pytest
from pyspark.sql import types as T

from lagledger.streaming.resume import ConfigurationMismatch, ResultSink, attempt, resume_stream

MADE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("root", T.DoubleType())])
INPUT = "event_id long, value double"


def root_of_positive():
    """Made inside a function, so that workers get it by value."""

    def root(frame):
        if (frame["value"] < 0).any():
            raise ValueError("negative value")
        kept = frame[frame["value"] != 99.0]
        return pd.DataFrame({"event_id": kept["event_id"], "root": kept["value"] ** 0.5})

    return root


root = root_of_positive()


def rows(df) -> set:
    return {(r["event_id"], r["root"], r["status"], r["error"]) for r in df.collect()}


def test_attempt_isolates_failing_events(spark):
    data = [(k, float(k * k)) for k in range(100)] + [(100, -1.0), (101, 99.0), (None, 4.0), (102, -7.0)]
    got = rows(attempt(spark.createDataFrame(data, INPUT).coalesce(1), "event_id", root, MADE))
    want = {(k, float(k), "done", None) for k in range(100)}
    want |= {(k, None, "processing_error", "ValueError: negative value") for k in (100, 102)}
    want |= {(101, None, "processing_error", "no result"), (None, None, "processing_error", "no key")}
    assert got == want
    assert attempt(spark.createDataFrame([], INPUT), "event_id", root, MADE).count() == 0


def test_a_restarted_stream_goes_on_and_skips_what_was_attempted(spark, tmp_path):
    inbox, folder, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def arrive(*ids):
        spark.createDataFrame([(k, -1.0 if k == 3 else float(k)) for k in ids], INPUT).coalesce(1).write.mode("append").parquet(inbox)

    def run(fingerprint="one", at=checkpoint):
        live = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(inbox)
        return resume_stream(live, "event_id", folder, at, fingerprint, root, MADE)[1]

    arrive(1, 2, 3)
    assert {r["event_id"]: r["status"] for r in run().collect()} == {1: "done", 2: "done", 3: "processing_error"}
    arrive(2, 3, 4, 4)  # repeats
    arrive(1, 5)
    got = run().collect()
    assert sorted(r["event_id"] for r in got) == [1, 2, 3, 4, 5]
    assert {r["config_sha256"] for r in got} == {"one"} and len({r["stream"] for r in got}) == 1 and len({r["batch_id"] for r in got}) == 3
    with pytest.raises(ConfigurationMismatch):
        run("two")
    # a lost checkpoint reads all files again, under another stream id: nothing is attempted twice or overwritten
    assert sorted(r["event_id"] for r in run(at=f"{tmp_path}/other").collect()) == [1, 2, 3, 4, 5]


def test_a_batch_run_again_leaves_the_same_rows(spark, tmp_path):
    sink = ResultSink(f"{tmp_path}/out", "event_id", "one", root, MADE)
    sink.open(spark)
    first = spark.createDataFrame([(1, 1.0), (2, 4.0)], INPUT)
    for _ in range(2):
        sink.write(first, "s", 0)
    sink.write(spark.createDataFrame([(2, 4.0), (3, 9.0)], INPUT), "s", 1)
    sink.write(first, "s", 0)  # replayed late
    assert sorted((r["event_id"], r["batch_id"]) for r in sink.results(spark).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_failing_events_cost_few_calls(spark, tmp_path):
    """One of 97 events fails: halving every batch took some 18 calls for each of them."""
    folder = str(tmp_path)

    def counting():
        def root(frame):
            with open(f"{folder}/calls", "a") as f:
                f.write(".")
            if (frame["event_id"] % 97 == 0).any():
                raise ValueError("poisoned event")
            return pd.DataFrame({"event_id": frame["event_id"], "root": frame["value"] * 2})

        return root

    df = spark.range(1, 20_001, 1, 1).selectExpr("id AS event_id", "CAST(id AS double) AS value")
    got = rows(attempt(df, "event_id", counting(), MADE).coalesce(1))
    want = {(k, None, "processing_error", "ValueError: poisoned event") if k % 97 == 0 else (k, 2.0 * k, "done", None) for k in range(1, 20_001)}
    assert got == want
    assert len(open(f"{folder}/calls").read()) <= 10 * (20_000 // 97)


def test_events_that_fail_only_together_are_kept(spark):
    def process(frame):
        if len(frame) > 1:
            raise ValueError("one at a time")
        return pd.DataFrame({"event_id": frame["event_id"], "root": frame["value"]})

    df = spark.range(0, 30, 1, 1).selectExpr("id AS event_id", "CAST(id AS double) AS value")
    assert rows(attempt(df, "event_id", process, MADE)) == {(k, float(k), "done", None) for k in range(30)}
