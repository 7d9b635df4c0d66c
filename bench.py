"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

A query's time covers building the plan and computing every output row and column (a
no-op sink), best of two runs after a warm-up of the session on the smallest tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rosterproof.plans.catalog import QUERIES  # noqa: E402
from rosterproof.session import local_session  # noqa: E402

HEADLINE = [
    "registry_clean",
    "registry_audit",
    "registry_audit_big",
    "dup_clusters",
    "cluster_edges",
    "flagged_topk",
    "dup_counts",
    "dup_topk",
    "rule_results_checklist",
    "text_normalise",
    "expiry_extract",
    "thai_id_extract",
    "doc_fields",
    "comparisons",
    "item_verdicts",
    "request_summary",
    "deep_results",
    "page_links",
    "json_file_links",
    "model_response_parse",
]
RUNS = 2


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "rosterproof-bench")
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in ("registry_audit", "rule_results_checklist", "comparisons"):
            run(spark, name, warm)
    times = {n: round(min(run(spark, n, sf_dir) for _ in range(RUNS)), 3) for n in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
