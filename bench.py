"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_MEM (driver memory, default 8g), BENCH_REPEAT (default 2; best run kept),
BENCH_QUERIES (comma list to restrict), BENCH_MODE (``stored``: derive the
airline tables once, store them as Parquet — timed as ``materialize_tables``
and counted in the total — and run the queries on them; ``views``: derive
the tables inside every query), BENCH_BUCKETS (stored mode: flight-keyed
tables bucketed on FlightID into this many buckets; default 0 = plain
Parquet). Each query runs to completion through the
``noop`` sink (full execution, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flight_search", "flight_status", "flight_search_filtered", "seat_map",
    "report_average_occupancy", "report_revenue_breakdown", "report_employee_hours",
    "report_cancellation_rate", "report_plane_activity", "report_summary",
    "staffing_feasibility", "available_pilots", "chain_continuity",
    "order_history", "complete_orders", "cancel_flights_orders",
    "ingest_orders", "ingest_phones", "ingest_flights_staffed", "ingest_bookings", "check_keys",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="bench-")

    from skyledger.session import get_session
    spark = get_session(
        master=f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="skyledger-bench",
        extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "8g"),
               "spark.local.dir": scratch,
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"})
    from skyledger.plans.catalog import OPS, QUERIES
    from skyledger.session import checkpoint_dir
    from skyledger.sources.io import materialize_views

    # warm-up: JVM class loading and code generation paths, not counted
    QUERIES["report_cancellation_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    mode = os.environ.get("BENCH_MODE", "stored")
    if mode == "stored":
        # The airline tables are derived from the driver tables once and stored as
        # Parquet (timed and counted below); the queries then read stored tables.
        t0 = time.perf_counter()
        root = f"{checkpoint_dir(spark)}/bench-tables-{uuid.uuid4().hex}"
        buckets = int(os.environ.get("BENCH_BUCKETS", "0")) or None
        tables = materialize_views(spark, sf_dir, root, buckets=buckets)
        times["materialize_tables"] = round(time.perf_counter() - t0, 3)
        run = lambda n: OPS[n](tables, spark, sf_dir)
    else:
        run = lambda n: QUERIES[n](spark, sf_dir)

    for n in names:
        best = float("inf")
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(n).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[n] = round(best, 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": f"sum of best-of-{repeat} query seconds ({len(names)} headline queries, "
                                f"tables {mode})",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
