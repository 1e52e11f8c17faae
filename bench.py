"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run whole and its result fetched.  Each is run ``$BENCH_RUNS``
times (2 unless set) and the fastest run counts, so that class loading and JIT
compilation of the first run are not billed; the first run and the median are
reported beside it.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from eventlens.plans import QUERIES
from eventlens.session import build_session

HEADLINE = [
    "tool_monthly", "monthly_counts", "top_repositories_by_month", "variant_breakdown", "monthly_totals",
    "velocity", "velocity_by_team_size", "size_distribution", "size_by_language", "message_stats", "mention_counts",
    "hash_sample_by_era", "text_features", "text_feature_rank_tests", "order_value_rank_test", "era_summary",
    "kendall_trend", "segmented_regression", "welch_t_test", "kernel_changepoints", "month_estimates",
    "stitched_series", "headline", "adaptive_windows", "growth_fits", "growth_projection", "centroid_drift",
    "stratified_split", "era_classifier", "streamed_tool_monthly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times, first, middle = {}, {}, {}
    for name in HEADLINE:
        elapsed = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).toArrow()
            elapsed.append(time.perf_counter() - t0)
        times[name], first[name] = round(min(elapsed), 3), round(elapsed[0], 3)
        middle[name] = round(statistics.median(elapsed), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first_run": first, "median": middle, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
