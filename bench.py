"""Runs the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from veriref.plans import registry
from veriref.session import local_session

HEADLINE = ["quick_verdict_report", "title_similarity_pairs", "best_candidate_composite", "existence_cascade_first_hit", "metadata_field_comparison", "triage_routes", "bm25_topk", "dense_topk", "rrf_fusion", "corpus_funnel", "stratified_rates", "per_order_rate_stats", "session_windows", "sliding_rate_limit", "numbered_marker_expand", "chunk_documents"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
