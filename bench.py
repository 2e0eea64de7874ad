"""Times the headline queries, each once after an untimed pass over the smallest tables.

``BENCH_SF_DIR``, ``BENCH_CPUS`` and optionally ``BENCH_QUERIES``; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docflow.session import local_session  # noqa: E402
from docflow.workload import QUERIES  # noqa: E402

HEADLINE = ("merge_chunks_200", "merge_chunks_overlap", "split_oversized", "resolve_spans", "resolve_groups", "assemble_pages",
            "combine_documents", "route_pages", "context_windows", "summarize_map", "summarize_fold", "summarize_map_budget",
            "merge_tree", "embed_chunks", "schema_violations", "classify_errors", "tool_calls", "render_requests",
            "job_progress", "reconcile_runs")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    # Untimed pass over the smallest tables: class loading, code generation, Python workers.
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in names if os.path.isdir(warm) else []:
        QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
