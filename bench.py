"""Headline timings. Prints one JSON line; every query runs from the raw tables to its last row."""
from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from paneltide.catalog import QUERIES  # noqa: E402
from paneltide.session import local_session  # noqa: E402

HEADLINE = [
    "panel_star", "panel_gappy", "ranked_edition", "score_and_rank", "percentile_rank", "rank_range_schemes",
    "average_rank", "winsorise_within_period", "exact_growth", "as_of_before_cut", "match_any_place",
    "weighted_tau_gappy", "weighted_tau_split", "walk_forward_summary", "baseline_windows", "ablation_deltas",
    "bootstrap_tau", "paired_gap", "rank_intervals", "candidate_gate", "early_rows", "mid_period_rows",
    "outlier_gate", "cross_source_divergence", "grade_runs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start the JVM before the first clock
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
