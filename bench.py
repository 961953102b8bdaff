"""Wall time of the headline queries: one warm-up, then the median of up to two timed runs.

A query that takes longer than five seconds is timed by its first run.

Every result is written in full to Spark's ``noop`` sink. Settings: BENCH_SF_DIR, BENCH_CPUS,
BENCH_RUNS. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewise.catalog import all_queries  # noqa: E402
from tablewise.session import build_session  # noqa: E402

ENOUGH_SECONDS = 5.0  # a query that took this long is not run again
WARM_UP = ("monthly_revenue", "column_profile_orders")
HEADLINE = (
    "monthly_revenue", "revenue_by_category", "customer_summary", "order_status_breakdown", "top_products",
    "revenue_by_state", "delivery_performance", "month_vs_last_month", "demand_last_30d", "mom_growth",
    "view_by_category", "view_entity_summary",
    "column_profile_orders", "column_profile_lineitem", "column_profile_documents", "duplicate_rows",
    "outlier_columns", "quality_scores", "clean_whole_table", "relationships", "join_view", "master_view",
    "kpis_orders", "kpis_session", "period_comparison", "kpi_alerts", "what_if",
    "chart_line_grouped", "chart_treemap", "chart_histogram", "chart_box", "chart_heatmap", "chart_cross_table",
    "session_latest_status", "notify_once", "event_log_rollup", "zip_ingest",
    "stream_daily_kpis", "stream_rate_flags", "stream_rate_windows", "category_forecast",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    for name in WARM_UP:  # starts the JVM's compilers; not timed
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        while len(taken) <= runs and sum(taken) < ENOUGH_SECONDS:
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
