"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion with the ``noop`` sink (all rows computed, nothing
collected). ``end_to_end`` is the whole upload run of the studied service: validate + clean the
faulty table, persist it once, compute every KPI section, health scores and insights.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.catalog import queries  # noqa: E402
from tillroll.plans import upload_run as flow  # noqa: E402
from tillroll.session import local_session  # noqa: E402
from tillroll.sources.fixtures import dirty  # noqa: E402

HEADLINE = ["clean_chain", "clean_report", "val_report", "kpi_summary", "kpi_monthly_revenue",
            "kpi_revenue_distribution", "kpi_customer_segments", "kpi_product_performance", "kpi_rfm",
            "win_pareto", "win_moving_avg", "top_customers", "kpi_all", "ins_all_by_country",
            "describe_numeric", "histogram"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def end_to_end(spark, sf: str) -> None:
    r = flow.run(dirty(spark, sf), on_error="clean")  # the faulty table has validation errors
    try:
        flow.execute([lambda: run(r.validation), lambda: run(r.metrics), lambda: run(r.insights),
                      lambda: run(r.key_insights)])
    finally:
        r.release()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus, app="tillroll-bench")
    qs = queries()
    # Warm-up: JVM start, code generation of the scan path (not timed).
    run(qs["kpi_summary"](spark, sf))
    times: dict[str, float] = {}
    for key in HEADLINE:
        t0 = time.time()
        run(qs[key](spark, sf))
        times[key] = round(time.time() - t0, 3)
    t0 = time.time()
    end_to_end(spark, sf)
    times["end_to_end"] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
