"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads.
Every query runs once to warm up and is then timed, its rows going to Spark's
``noop`` sink so that no result is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowstrata.plans.queries import REGISTRY  # noqa: E402
from flowstrata.session import build_session  # noqa: E402

HEADLINE = [
    "silver_packets",
    "validated_json",
    "gold_hourly",
    "gold_hourly_dense",
    "gold_by_protocol",
    "traffic_totals",
    "protocol_breakdown",
    "top_src_ips",
    "port_view_hide_os_noise",
    "live_breakdowns",
    "minute_buckets",
    "protocol_windows",
    "packet_search_combined",
    "anonymized_packets",
    "latency_percentiles",
    "manifest_current",
    "frame_decode",
    "flows",
    "flow_sessions",
    "volume_spikes",
]


def _run(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "flowstrata-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        _run(spark, sf_dir, name)
        timings[name] = round(_run(spark, sf_dir, name), 4)
    packets = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "packets": packets,
        "silver_packets_per_sec": round(packets / timings["silver_packets"]),
        "decoded_frames_per_sec": round(packets / timings["frame_decode"]),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
