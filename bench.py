"""Time the headline queries; prints one JSON line.

Each query runs once untimed on the smallest tables (code generation, Python workers) and
once timed at BENCH_SF_DIR, from building the plan to the last row written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from lexspan.plans import registry
from lexspan.session import build_session

HEADLINE = [
    "bm25_topk", "bm25_multi_query", "bm25_term_stats", "dense_topk", "dense_centroid_topk", "rrf_hybrid", "rerank_evidence", "sweep_grid",
    "retrieval_metrics", "ndcg_at_k", "value_inventory", "content_state", "document_decisions", "audit_summary", "dup_summary",
    "normalized_dup_groups", "edge_metrics", "dangling_edges", "one_hop_expansion", "priority_topn", "legal_eligibility",
    "policy_gate", "citation_validation", "token_windows_440_48", "forward_fill_sections", "visible_page_text", "parse_articles", "char_chunks",
    "latency_distribution", "redacted_trace"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    registry.load()
    timings = {}
    for name in HEADLINE:
        run = registry.QUERIES[name]
        if os.path.isdir(small):
            run(spark, small).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
