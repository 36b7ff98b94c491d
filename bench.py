"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores
(default 8), BENCH_QUERIES a comma-separated choice. Each query is planned and run
to its last row twice in one warm session; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from foliotree.plans.queries import QUERIES
from foliotree.session import build_session

HEADLINE = [
    "page_fixed", "page_lines", "page_paragraphs", "page_counts",
    "summary_fallback", "summary_rollup", "summary_model",
    "tree_fallback", "tree_text", "tree_model", "nest_and_unnest", "heading_tree",
    "retrieve_fallback", "retrieve_ranges", "context", "answer_requests",
    "chunk_fold", "list_conversations", "append_messages", "delete_document", "apply_status", "build_index",
]
RUNS = 2


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    scratch = tempfile.TemporaryDirectory(prefix="foliotree-bench-", ignore_cleanup_errors=True)
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": scratch.name,
    })
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        times[name] = round(min(run(QUERIES[name], spark, sf_dir) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))
    spark.stop()
    scratch.cleanup()


if __name__ == "__main__":
    main()
