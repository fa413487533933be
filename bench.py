"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query
runs once to warm up and then BENCH_RUNS times; the best time counts.
"""

from __future__ import annotations

import json
import os
import time

from netloom.catalog import QUERIES
from netloom.session import local_session

HEADLINE = (
    "a01_read_packets", "b06_tls_propagation", "b19_relative_numbers", "c1_frame_dedup",
    "c2_flow_aggregation", "c2_tls_flows", "c5_running_counters", "c04k_segment_labels", "d01_beaconing",
    "d02_data_exfil", "d03_new_destination", "d04_traffic_anomaly", "d08_tag_assembly",
    "d09_baseline", "e01_tags_to_alerts", "e06_reclassification", "f04_cumulative_stats",
    "f12_top_talkers", "f15_threat_summary", "f20_alert_page", "f21_grouped_alerts",
    "f22_connection_page", "f24_related_alerts", "f29_alert_context", "h05_flow_enrichment",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        best = float("inf")
        for attempt in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                best = min(best, time.perf_counter() - started)
        times[name] = round(best, 3)
    result = {
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
