"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "headline_total", "value": sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full with the ``noop`` sink (no rows collected);
the time per query is the best of ``$BENCH_REPEAT`` runs (default 2) after
one untimed warm-up run of the flagship on the same data.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "events_flagship",        # grid -> segmentation -> events -> rate -> CI
    "rain_runoff_samples",    # two segmentations + two interval joins + roll-ups + join
    "sample_rain_overlap",    # interval overlap join + aggregate
    "rain_threshold_sweep",   # segmentation for four thresholds in one plan
    "rain_events_long",       # chunked grid + chunked segmentation, no period reset
    "gap_events",             # time-gap events on raw rows
    "first_line_per_order",   # keep-first per key (partial min aggregate)
    "price_ci",               # four-table join + grouped t-intervals
    "box_stats",              # exact quartiles + whisker pass
    "gram_matrix",            # one-pass Gram of an 18-column design
    "ols_coefficients",       # Gram + driver solve
    "variance_components",    # random-intercept moments (staged base, K=3)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from eventlab.session import build_session
    from eventlab.plans.catalog import QUERIES

    spark = build_session("eventlab-bench", cpus, shuffle_partitions=int(cpus) * 2)
    QUERIES["events_flagship"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
