"""Time the headline queries: one JSON line on stdout.

Each query is planned and run completely (all rows, all columns, no output) and
the better of two runs counts. ``ingest`` is the write of the stored tables that
the other queries read; it runs once.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ridgelog.catalog import all_queries  # noqa: E402
from ridgelog.catalog import tables  # noqa: E402
from ridgelog.session import build_session, release_scratch  # noqa: E402

HEADLINE = (
    "select_all filter_equals filter_contains filter_and_or time_range_absolute log_search document_search tail_filter in_subquery spec_query "
    "count_distinct message_length_profile grouped_values merge_partials errors_by_service levels_over_time slow_requests top_error_sources "
    "per_minute_activity memory_usage service_level_minutes index_suggestions service_hourly errors_daily trace_rollup latest_per_key order_by_all "
    "offset_page keyset_page time_functions display_functions trace_ids trace_summary span_summary span_tree trace_timeline trace_sessions "
    "error_tags error_tags_documents error_statistics error_samples error_anomalies histogram_statistics sliding_rate counter_increase "
    "metric_snapshot alert_cooldown parse_lines parse_documents parse_and_merge ingest_lines decode_syslog rule_violations transform_rows "
    "partition_pruned_count storage_statistics export_csv stream_errors stream_ingest"
).split()


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            # driver and executors are one process here; on a cluster this is a shared folder
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ridgelog-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    start = time.perf_counter()
    tables.logs_path(spark, sf_dir)
    for derive in (tables.raw_lines, tables.request_bodies, tables.syslog_lines):
        derive(spark, sf_dir)
    times["ingest"] = round(time.perf_counter() - start, 3)
    only = sys.argv[1:]
    for name in only or HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            run(queries[name](spark, sf_dir))
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    release_scratch(spark)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
