"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and ``$BENCH_RUNS`` times (default 1) for the
median. Results go to a sink that computes every column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "normalize_documents", "dict_ngram_match", "dict_ngram_match_join", "extract_orders", "evaluation_summary",
    "slice_breakdown", "connections", "symmetric_edges", "components", "shortest_paths", "route_orders",
    "edit_distance_best", "similarity_topk", "resolve_entities", "bio_labels", "dedupe_resequence",
    "stratified_split", "expand_templates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE

    from itinera.plans.session import local_session
    from workload.queries import QUERIES
    from workload.views import table

    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    orders = table(spark, sf_dir, "orders_text").count()
    out = {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
           "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}
    if "extract_orders" in seconds:
        out["extracted_sentences_per_sec"] = round(orders / seconds["extract_orders"])
    if "route_orders" in seconds:
        out["routed_sentences_per_sec"] = round(orders / seconds["route_orders"])
    print(json.dumps(out))


if __name__ == "__main__":
    main()
