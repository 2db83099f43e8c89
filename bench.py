"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS.
Each query is run to completion into a sink that keeps nothing; the best of
BENCH_RUNS runs after one warm-up counts.
"""

from __future__ import annotations

import json
import os
import time

from keytide.plans.queries import QUERIES
from keytide.session import local_session

HEADLINE = [
    "key_counts",
    "fnv_partition",
    "route_vanilla",
    "sequence",
    "bucketed",
    "lossy_lifecycle",
    "hot_keys",
    "sketch_stats",
    "partition_rate",
    "weight_snapshots",
    "target_match",
    "control_replay",
    "route_hot",
    "route_hot_shuffled",
    "message_sets",
    "delivery_log",
    "sync_events",
    "key_total_order",
    "order_violations",
    "sticky_rr",
    "ingest_accept",
    "ingest_reject",
    "trace_latency",
    "latency_by_key",
    "trace_join",
    "load_comparison",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    messages = spark.read.parquet(f"{sf_dir}/events.parquet").count()

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in HEADLINE:
        once(name)
        timings[name] = round(min(once(name) for _ in range(runs)), 3)
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "rows_per_sec": {n: round(messages / t) for n, t in timings.items()},
                "messages": messages,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
