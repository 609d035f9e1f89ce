"""Benchmark: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from netweir.plans import load
from netweir.session import local_session

HEADLINE = [
    "enrich_full", "enrich_geo", "enrich_geo_distinct", "rollup_1m", "rollup_1h", "rollup_1m_to_1h",
    "top_src_ips", "top_conversations", "site_matrix", "as_pairs", "country_map", "transit_series", "iface_flow_bps",
    "counter_rate", "increase_fine_grid", "iface_utilization", "topk_interfaces_in", "site_bandwidth",
    "availability_by_site", "downsample_5m", "replica_dedup", "locf_grid", "iface_correlation",
    "flow_anomaly", "alert_states", "alert_intervals", "notification_schedule",
    "targets_snmp", "illegal_transitions", "step_outcomes", "param_validation",
    "stream_enrich", "stream_rollup_1m",
]


def run(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every row and column without collecting anything.
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    queries, _ = load()
    chosen = sys.argv[1:] or HEADLINE
    run(spark, queries["top_protocols"], sf_dir)  # start the JVM's code paths once
    times = {}
    for name in chosen:
        times[name] = round(run(spark, queries[name], sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
