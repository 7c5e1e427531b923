"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetwatch import catalog  # noqa: E402
from fleetwatch.session import build_session  # noqa: E402

# page-view and gate queries first, then the heavier fleet-wide work
HEADLINE = [
    "g26_window_count", "g26_agent_totals", "g25_agent_days", "g25_status_counts", "g25_top_tasks",
    "g4_per_agent", "d11_open_queue", "b1_error_rate", "b6_tool_drift", "b7_loop_openings",
    "b11_new_error_classes", "b14_end_state_divergence", "b17_evaluate_facts", "c1_ewma_card",
    "c3_mad_z", "d8_attribution", "g9_agent_state", "g22_alarm_latency_card", "a3_span_events",
    "a6_signed_batches", "e3_ledger", "e4_verify_chain", "e5_merkle_root", "e7_seal_roots", "x7_masked_texts",
    "x6_cost_outliers", "x9_baselines", "b17_incremental", "s2_sliding_error_rate", "s7_alarm_log",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench")
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["g26_window_count"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            # every row and column is produced, nothing is sent to the driver
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            t = time.perf_counter() - t0
            best = t if best is None else min(best, t)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
