"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lagledger.plans.catalogue import collect
from lagledger.session import local_session

HEADLINE = (
    "j4_nearest_join", "a1_epoch_summary", "j3_point_in_interval", "w3_runs", "w2_centered_median", "w17_offset_medians", "p6_frame_quality",
    "p9_closure_category", "t3_blind_shuffle", "j1_ledger_join", "w21_assemble_timeline", "a2_group_metrics", "g4_frame_spectrum", "j19_lag_correlation",
    "c1_leak_scan_documents", "c3_target_tokens", "c4_template_match", "q1_cliffs_delta", "q2_bootstrap_full", "q3_permutation_full",
    "w14_min_separation", "w15_cluster_events", "g12_estimate_release", "r3_track_objects",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = collect().queries
    spark.read.parquet(f"{folder}/events.parquet").count()
    taken = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
