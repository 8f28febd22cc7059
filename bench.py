"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and fully executed into Spark's ``noop`` sink (no driver collect),
three times; the reported time per query is the median, the metric is their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stock_by_location",
    "stock_dashboard",
    "latest_snapshot",
    "stock_status_detail",
    "turnover_by_item",
    "top_expiry_lots",
    "movement_by_location",
    "event_feed",
    "consumption_daily_pivot",
    "top_items_by_value",
    "waste_daily_dense",
    "expiring_by_category",
    "abc_classify",
    "eoq",
    "safety_stock",
    "rop",
    "latest_risk",
    "supplier_order_kpis",
    "labor_daily",
    "scan_dedupe",
    "fc_metrics",
    "fc_select",
]


def main() -> None:
    from stockroom.plans.catalog import REGISTRY
    from stockroom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="stockroom-bench")
    keys = [k for k in HEADLINE if k in REGISTRY]
    REGISTRY[keys[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times: dict[str, float] = {}
    for k in keys:
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            REGISTRY[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[k] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_median_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "reps": reps,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
