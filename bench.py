"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from spanledger.catalog import registry
from spanledger.session import local_session

HEADLINE = [
    "credits_by_model", "token_coverage", "chat_totals", "session_rollup", "span_dedup", "span_merge", "credits_by_repository", "credits_by_user",
    "context_asof", "ancestor_walk", "series_latest", "counter_increase", "tokens_by_model", "token_series", "hist_quantile", "latency_percentiles",
    "slowest_tools", "quality_section", "trace_credits", "meter_totals", "coverage_funnel", "delivery_cycles", "cycle_steps", "developer_balance",
    "billing_reconcile", "feed_scan", "file_span_scan", "span_store_scan", "transcript_replay", "quota_parse",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["chat_totals"](spark, sf_dir).collect()  # start-up is not part of any query
    took = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
