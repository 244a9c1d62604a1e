"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from roadlake.queries import QUERIES
from roadlake.session import build_session, ensure_shared_dir

HEADLINE = [
    "src_gps_decode",
    "src_fault_decode",
    "dedup_gps",
    "enrich_device",
    "daily_summary",
    "trips",
    "idling_episodes",
    "hotspots_rounded",
    "hotspots_geohash",
    "device_day_stats",
    "utilization_sorted_page",
    "efficiency_weekly_fleet",
    "fault_events",
    "fault_suppression",
    "alert_notifications",
    "alert_path",
    "gps_path",
    "fault_path",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    }
    spark = build_session("bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_dir(spark)
    # Start the JVM's compilers and the Python workers on the small queries.
    for name in ("device_day_stats", "fault_suppression"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
