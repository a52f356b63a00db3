"""Bench: load the marketplace tables once, build the order view once, time every report.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 3, median per report). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


#: Reports with a row for each order or review; they are run in full, but not sent to the driver.
ROW_LEVEL = {"order_analysis", "payment_methods", "ext_delay_alerts", "ext_installment_priority", "ext_next_order_after_complaint", "ext_running_gmv"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))

    from cxlens.plans import all_reports
    from cxlens.plans.order_view import materialize_order_view, read_order_view
    from cxlens.session import local_session
    from cxlens.sources import derive_marketplace, read_parquet_tables, write_tables

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", 2 * cpus)), app_name="cxlens-bench")
    base = spark.conf.get("spark.checkpoint.dir")
    work = tempfile.mkdtemp(prefix="bench-", dir=base) if base.startswith("/") else base + "/bench"
    tables_dir, view_dir = os.path.join(work, "tables"), os.path.join(work, "order_view")

    t0 = time.perf_counter()
    write_tables(derive_marketplace(spark, sf_dir), tables_dir, concurrent_jobs=4)
    load_sec = time.perf_counter() - t0
    tables = read_parquet_tables(spark, tables_dir)

    t0 = time.perf_counter()
    materialize_order_view(tables, view_dir)
    view_sec = time.perf_counter() - t0
    view = read_order_view(spark, view_dir)

    reports = all_reports()
    times: dict[str, float] = {}
    for name, rep in reports.items():
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            df = rep.run(tables, view=None if rep.uses is None else view)
            if name in ROW_LEVEL:
                df.write.format("noop").mode("overwrite").save()
            else:
                df.collect()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)

    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "sum_of_report_seconds", "value": total, "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "load_tables_sec": round(load_sec, 3), "build_view_sec": round(view_sec, 3),
        "end_to_end_sec": round(total + load_sec + view_sec, 3), "cpus": cpus,
        "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
