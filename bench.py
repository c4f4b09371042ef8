"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_RUNS`` (default 2; the best run counts), ``BENCH_QUERIES`` (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "c02_normalise", "c03_mask", "d03_asof_tail", "d04_bounded_asof", "d05_interval_count", "d06_interval_latest",
    "d07_look_ahead", "e05_share_columns", "e07_tail_statistics", "e08_top_values", "e10_gap_moments",
    "e13_recency_counts", "e14_group_text", "e15_top_per_label", "e19_exclusion_count", "f08_longest_run",
    "f09_first_appearance_ids", "g09_sample_entropy", "h02_template_match", "h06_vocabulary", "h08_tfidf",
    "h11_mean_vector", "h16_cosine_to_centroids", "h20_untailed_terms", "i02_stratified_folds", "i03_group_folds",
    "i10_weighted_f1", "i16_feature_assembly",
]


def main() -> None:
    from logfault.plans import QUERIES
    from logfault.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
        # The test tables are a few MB: let even small shuffles use all cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
