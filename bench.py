"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ingest_report", "html_to_text", "near_duplicates", "chunk_structure", "chunk_quality",
    "vector_topk_cosine", "keyword_topk", "fuse_rrf", "build_context", "match_evidence",
    "verify_answers", "ir_metrics", "aggregate_run", "bootstrap_ci", "resolve_entities",
    "khop_paths", "trajectory_view", "agent_report", "detect_loops", "usage_rollup",
]


def main() -> None:
    from attestry import plans
    from attestry.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "attestry-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__attestry__textPartitions=cpus,
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
