"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full through the ``noop`` sink (no collect to the
driver): one warm-up run, then the median of $BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodgelake.plans.registry import QUERIES  # noqa: E402
from lodgelake.session import build_session  # noqa: E402

HEADLINE = [
    "hotel_performance", "top_customers", "monthly_sales", "booking_trends", "platform_kpis",
    "booking_status_stats", "user_dashboard_stats", "hotel_inventory", "price_quotes", "cancellation_quotes",
    "booking_detail", "bookings_feed", "user_recent_bookings", "apply_booking_commands", "apply_account_commands",
    "apply_room_commands", "validate_new_users", "append_bookings", "live_booking_counts", "orphan_booking_hotels",
]


def run(name: str, spark, sf_dir: str) -> float:
    """Seconds to build and execute the query; building counts, as some operators write a checkpoint while built."""
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="lodgelake-bench", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    times = {}
    for name in names:
        run(name, spark, sf_dir)  # warm-up: JIT, file listing, broadcast of dims
        times[name] = round(statistics.median(run(name, spark, sf_dir) for _ in range(runs)), 4)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total_median", "value": round(sum(times.values()), 4), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "runs": runs, "cpus": cpus, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
