"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from bibliodyne.plans import catalog
from bibliodyne.session import builder

HEADLINE = (
    "gr_similar_papers", "gr_candidate_signals", "gr_neighborhood", "rrf_fuse", "vec_knn_papers", "agg_trending_counts", "jn_run_history", "set_search_dedup", "sink_upsert_coalesce",
    "fn_chunk_markdown", "topk_run_papers", "learn_rocchio", "agg_merge_passes", "win_latest_breakdown", "sink_edges_idempotent", "str_feedback_counts",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = builder("bench", cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "median seconds, summed over the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
