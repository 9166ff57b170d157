"""Aggregation, merging, rollups, sorting, pages, saved queries, scalar functions, charts."""

from datetime import datetime

from pyspark.sql import functions as F

from ridgelog.catalog.registry import query
from ridgelog.catalog.tables import ALL_HOURS, AS_OF, LOGS, document_logs, event_logs, stored_logs, table
from ridgelog.functions import scalars as x
from ridgelog.operators import aggregates as a
from ridgelog.operators import charts as d
from ridgelog.operators import pages as p
from ridgelog.operators import rollups as m
from ridgelog.operators.filters import Filter
from ridgelog.operators.query import Aggregation, OrderBy, QuerySpec, run_query
from ridgelog.operators.querylog import index_suggestions
from ridgelog.plans import templates as t
from ridgelog.plans.widgets import Widget, widget_data

W = "WITH " + LOGS + " "
SPRING = "spring-boot-app"


def _logs(spark, sf_dir):
    return event_logs(spark, sf_dir)


def _amounts(spark, sf_dir):
    return _logs(spark, sf_dir).withColumn("duration", x.attr_double("duration_ms"))


# -- aggregation ------------------------------------------------------------------------------


@query("count_rows", W + "SELECT count(*) AS count_, count(NULLIF(a_exception, '')) AS count_exception FROM logs")
def count_rows(spark, sf_dir):
    logs = _logs(spark, sf_dir).withColumn("exception", F.col("attributes")["exception"])
    spec = QuerySpec("counts", aggregations=(Aggregation("COUNT"), Aggregation("COUNT", "exception")))
    return run_query(logs, spec, known_fields=("exception",))


@query("count_distinct", W + "SELECT service, count(DISTINCT trace_id) AS traces, count(DISTINCT span_id) AS spans FROM logs GROUP BY service")
def count_distinct(spark, sf_dir):
    spec = QuerySpec(
        "distinct",
        fields=("service",),
        aggregations=(Aggregation("COUNT_DISTINCT", "trace_id", "traces"), Aggregation("COUNT_DISTINCT", "span_id", "spans")),
        group_by=("service",),
    )
    return run_query(_logs(spark, sf_dir), spec)


@query(
    "sum_avg_min_max",
    W
    + """SELECT level, round(sum(TRY_CAST(a_duration_ms AS DOUBLE)), 4) AS total, round(avg(TRY_CAST(a_duration_ms AS DOUBLE)), 6)
 AS mean, min(TRY_CAST(a_duration_ms AS DOUBLE)) AS lowest, max(TRY_CAST(a_duration_ms AS DOUBLE)) AS highest FROM logs GROUP BY level""",
)
def sum_avg_min_max(spark, sf_dir):
    spec = QuerySpec(
        "amounts",
        fields=("level",),
        aggregations=(
            Aggregation("SUM", "duration", "total"),
            Aggregation("AVG", "duration", "mean"),
            Aggregation("MIN", "duration", "lowest"),
            Aggregation("MAX", "duration", "highest"),
        ),
        group_by=("level",),
    )
    rows = run_query(_amounts(spark, sf_dir), spec, known_fields=("level", "duration"))
    return rows.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("group_by_fields", W + "SELECT DISTINCT service, level FROM logs")
def group_by_fields(spark, sf_dir):
    return run_query(_logs(spark, sf_dir), QuerySpec("groups", group_by=("service", "level")))


@query("having", W + "SELECT service, level, count(*) AS total FROM logs GROUP BY service, level HAVING count(*) > 150")
def having(spark, sf_dir):
    grouped = _logs(spark, sf_dir).groupBy("service", "level").agg(F.count(F.lit(1)).alias("total"))
    return a.having(grouped, F.col("total") > 150)


@query(
    "message_length_profile",
    W
    + """SELECT service, level, count(*) AS total_logs, count(DISTINCT trace_id) AS unique_traces,
 round(avg(strlen(message)), 6) AS avg_message_length, max(strlen(message)) AS max_message_length,
 round(quantile_cont(strlen(message), 0.95), 6) AS p95_message_length FROM logs GROUP BY service, level HAVING count(*) > 10""",
)
def message_length_profile(spark, sf_dir):
    profile = a.message_length_profile(_logs(spark, sf_dir), min_rows=10)
    return profile.withColumns(
        {"avg_message_length": F.round("avg_message_length", 6), "p95_message_length": F.round("p95_message_length", 6)}
    )


@query(
    "document_length_profile",
    """SELECT source AS service, count(*) AS total_logs, round(avg(strlen(text)), 6) AS avg_message_length,
 max(strlen(text)) AS max_message_length, round(quantile_cont(strlen(text), 0.95), 6) AS p95_message_length
 FROM documents GROUP BY source""",
)
def document_length_profile(spark, sf_dir):
    profile = a.message_length_profile(document_logs(spark, sf_dir), keys=("service",)).drop("unique_traces")
    return profile.withColumns(
        {"avg_message_length": F.round("avg_message_length", 6), "p95_message_length": F.round("p95_message_length", 6)}
    )


@query("count_if", W + "SELECT service, count(*) FILTER (level IN ('error', 'fatal')) AS failures, count(*) FILTER (level = 'warn') AS warnings FROM logs GROUP BY service")
def count_if(spark, sf_dir):
    return _logs(spark, sf_dir).groupBy("service").agg(
        F.count_if(F.col("level").isin("error", "fatal")).alias("failures"),
        F.count_if(F.col("level") == "warn").alias("warnings"),
    )


@query(
    "grouped_values",
    W
    + """SELECT level, string_agg(service || '=' || n, ',' ORDER BY service) AS services FROM (SELECT level, service, count(*) AS n
 FROM logs GROUP BY level, service) GROUP BY level""",
)
def grouped_values(spark, sf_dir):
    rows = a.grouped_values(_logs(spark, sf_dir), ["level"], "service")
    text = F.transform("service_rows", lambda r: F.concat_ws("=", r["value"], r["rows"].cast("string")))
    return rows.select("level", F.array_join(text, ",").alias("services"))


@query("facet_values", W + "SELECT DISTINCT service FROM logs")
def facet_values(spark, sf_dir):
    return a.facet_values(_logs(spark, sf_dir), "service")


_NODES = (("debug",), ("info", "warn", "WARN"), ("error", "fatal", "ERROR"))


@query(
    "merge_partials",
    W
    + """SELECT service, count(*) AS n, round(sum(coalesce(TRY_CAST(a_duration_ms AS DOUBLE), 0)), 4) AS total,
 arg_min(node, node) AS node FROM (SELECT *, CASE WHEN level = 'debug' THEN 'node-0' WHEN level IN ('info', 'warn', 'WARN')
 THEN 'node-1' ELSE 'node-2' END AS node FROM logs) GROUP BY service""",
)
def merge_partials(spark, sf_dir):
    """Each node holds the logs of some levels and aggregates them; the partials are merged."""
    logs = _amounts(spark, sf_dir)
    partials = [
        logs.filter(F.col("level").isin(*levels))
        .groupBy("service")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total"))
        .withColumn("node", F.lit(f"node-{i}"))
        for i, levels in enumerate(_NODES)
    ]
    partials.append(lambda: spark.read.parquet(f"{sf_dir}/no_such_node.parquet"))
    return a.merge_partials(partials, ["service"]).withColumn("total", F.round("total", 4))


@query(
    "concat_sources",
    """SELECT source, count(*) AS n, sum(strlen(message)) AS bytes FROM (SELECT 'documents' AS source, text AS message FROM documents
 UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY source""",
)
def concat_sources(spark, sf_dir):
    def source(name):
        return lambda: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col("text").alias("message"))

    rows = a.concat_sources([source(n) for n in ("documents", "conversations", "missing", "benchmark")])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("message")).alias("bytes"))


_SHARD = "CAST(CAST('0x' || left(md5(key), 8) AS BIGINT) % {} AS INT)"


@query(
    "shard_counts",
    W + f"SELECT {_SHARD.format(16)} AS shard, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS keys FROM (SELECT service AS key, count(*) AS n FROM logs GROUP BY 1) GROUP BY 1",
)
def shard_counts(spark, sf_dir):
    return a.shard_counts(_logs(spark, sf_dir), "service", 16)


@query(
    "shard_totals",
    f"SELECT {_SHARD.format(64)} AS shard, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS keys FROM (SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 1) GROUP BY 1",
)
def shard_totals(spark, sf_dir):
    return a.shard_counts(table(spark, sf_dir, "events"), "user_id", 64)


@query("value_rows", W + "SELECT service, message AS value, count(*) AS rows FROM logs GROUP BY 1, 2")
def value_rows(spark, sf_dir):
    return a.value_rows(_logs(spark, sf_dir), ["service"], "message")


# -- saved and dashboard queries --------------------------------------------------------------


@query(
    "errors_by_service",
    W
    + """SELECT service, count(*) AS error_count, count(DISTINCT trace_id) AS unique_requests FROM logs WHERE level = 'error'
 AND timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 744 HOUR GROUP BY service ORDER BY error_count DESC, service LIMIT 20""",
)
def errors_by_service(spark, sf_dir):
    return t.errors_by_service(_logs(spark, sf_dir), AS_OF, hours=ALL_HOURS)


@query(
    "levels_over_time",
    W
    + """SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS time_bucket, level, count(*) AS count FROM logs
 WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 744 HOUR GROUP BY 1, 2""",
)
def levels_over_time(spark, sf_dir):
    return t.levels_over_time(_logs(spark, sf_dir), AS_OF, hours=ALL_HOURS, minutes=5)


@query(
    "slow_requests",
    W
    + """SELECT timestamp, service, trace_id, message, TRY_CAST(a_response_time AS DOUBLE) AS response_time_ms FROM logs
 WHERE TRY_CAST(a_response_time AS DOUBLE) > 1000 ORDER BY response_time_ms DESC, id LIMIT 100""",
)
def slow_requests(spark, sf_dir):
    return t.slow_requests(_logs(spark, sf_dir), AS_OF, hours=ALL_HOURS)


@query(
    "logs_of_trace",
    W + "SELECT timestamp, level, service, message, span_id, a_user_id AS user_id FROM logs WHERE trace_id = md5('trace-7')",
)
def logs_of_trace(spark, sf_dir):
    import hashlib

    rows = t.logs_of_trace(_logs(spark, sf_dir), hashlib.md5(b"trace-7").hexdigest())
    return rows.withColumn("user_id", x.attr("user_id")).drop("attributes")


@query(
    "top_error_sources",
    W
    + """SELECT service, count(*) AS error_count, count(DISTINCT trace_id) AS affected_requests, min(timestamp) AS first_error,
 max(timestamp) AS last_error FROM logs WHERE level = 'error' GROUP BY service ORDER BY error_count DESC, service LIMIT 10""",
)
def top_error_sources(spark, sf_dir):
    return t.top_error_sources(_logs(spark, sf_dir), AS_OF, hours=ALL_HOURS)


@query("level_histogram", W + "SELECT level, count(*) AS count FROM logs GROUP BY level")
def level_histogram(spark, sf_dir):
    return t.level_histogram(_logs(spark, sf_dir))


@query(
    "per_minute_activity",
    W + "SELECT date_trunc('minute', timestamp) AS minute, count(*) AS log_count, count(DISTINCT service) AS service_count FROM logs GROUP BY 1",
)
def per_minute_activity(spark, sf_dir):
    return a.per_minute_activity(_logs(spark, sf_dir))


@query("service_levels", W + "SELECT service, level, count(*) AS count FROM logs WHERE level = 'error' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5")
def service_levels(spark, sf_dir):
    return t.service_levels(_logs(spark, sf_dir), AS_OF, "error", hours=ALL_HOURS)


@query("healthy_checks", W + f"SELECT count(*) AS healthy_checks FROM logs WHERE service = '{SPRING}' AND a_metric_type = 'health_check' AND a_health_status = 'UP'")
def healthy_checks(spark, sf_dir):
    return t.healthy_checks(_logs(spark, sf_dir), AS_OF, SPRING, minutes=ALL_HOURS * 60)


@query(
    "memory_usage",
    W
    + f"""SELECT date_trunc('minute', timestamp) AS time, round(avg(TRY_CAST(a_memory_usage_percent AS DOUBLE)), 6) AS memory_percent
 FROM logs WHERE service = '{SPRING}' AND a_metric_type = 'system' GROUP BY 1""",
)
def memory_usage(spark, sf_dir):
    rows = t.memory_usage(_logs(spark, sf_dir), AS_OF, SPRING, hours=ALL_HOURS)
    return rows.withColumn("memory_percent", F.round("memory_percent", 6))


@query("request_count", W + f"SELECT max(TRY_CAST(a_request_count AS BIGINT)) AS total_requests FROM logs WHERE service = '{SPRING}' AND a_metric_type = 'performance'")
def request_count(spark, sf_dir):
    return t.request_count(_logs(spark, sf_dir), AS_OF, SPRING, hours=ALL_HOURS)


@query("error_rate", W + f"SELECT round(avg(TRY_CAST(a_error_rate AS DOUBLE) * 100), 6) AS avg_error_rate FROM logs WHERE service = '{SPRING}' AND a_metric_type = 'performance'")
def error_rate(spark, sf_dir):
    rows = t.error_rate(_logs(spark, sf_dir), AS_OF, SPRING, hours=ALL_HOURS)
    return rows.select(F.round("avg_error_rate", 6).alias("avg_error_rate"))


@query("average_response_time", W + f"SELECT round(avg(TRY_CAST(a_avg_response_time_ms AS DOUBLE)), 6) AS avg_response_ms FROM logs WHERE service = '{SPRING}' AND a_metric_type = 'performance'")
def average_response_time(spark, sf_dir):
    rows = t.average_response_time(_logs(spark, sf_dir), AS_OF, SPRING, hours=ALL_HOURS)
    return rows.select(F.round("avg_response_ms", 6).alias("avg_response_ms"))


@query(
    "hourly_performance",
    W
    + f"""SELECT date_trunc('hour', timestamp) AS hour, round(coalesce(avg(TRY_CAST(a_avg_response_time_ms AS DOUBLE)), -1), 6) AS avg_response_time,
 count(*) AS request_count FROM logs WHERE service = '{SPRING}' AND a_metric_type = 'performance' GROUP BY 1""",
)
def hourly_performance(spark, sf_dir):
    rows = t.hourly_performance(_logs(spark, sf_dir), SPRING)
    return rows.withColumn("avg_response_time", F.round(F.coalesce("avg_response_time", F.lit(-1.0)), 6))


@query(
    "phrase_timeline",
    W
    + f"""SELECT date_trunc('minute', timestamp) AS time, count(*) AS log_count FROM logs WHERE service = '{SPRING}'
 AND message LIKE '%Request completed%' GROUP BY 1""",
)
def phrase_timeline(spark, sf_dir):
    return t.phrase_timeline(_logs(spark, sf_dir), AS_OF, SPRING, "Request completed", hours=ALL_HOURS)


@query(
    "error_patterns_by_exception",
    W + f"SELECT level, a_exception AS exception_type, count(*) AS error_count FROM logs WHERE service = '{SPRING}' AND level IN ('ERROR', 'WARN') GROUP BY 1, 2",
)
def error_patterns_by_exception(spark, sf_dir):
    return t.error_patterns(_logs(spark, sf_dir), AS_OF, SPRING, hours=ALL_HOURS)


@query(
    "service_level_minutes",
    W
    + """SELECT service, level, date_trunc('minute', timestamp) AS minute, count(*) AS count,
 round(coalesce(avg(TRY_CAST(a_duration_ms AS DOUBLE)), -1), 6) AS avg_duration FROM logs GROUP BY 1, 2, 3""",
)
def service_level_minutes(spark, sf_dir):
    rows = t.service_level_minutes(_logs(spark, sf_dir), AS_OF, hours=ALL_HOURS)
    return rows.withColumn("avg_duration", F.round(F.coalesce("avg_duration", F.lit(-1.0)), 6))


@query(
    "index_suggestions",
    """WITH q AS (SELECT 'SELECT * FROM logs WHERE level = ''' || event_type || ''' AND user' || CAST(user_id % 4 AS VARCHAR) ||
 ' > 5 AND value >= 1 OR name LIKE ''x''' AS query FROM events),
 u AS (SELECT unnest(regexp_extract_all(query, '\\b(\\w+)\\s*(?:=|>|<|>=|<=|IN|LIKE)', 1)) AS field FROM q)
 SELECT field, 'bloom_filter' AS index_type, count(*) AS uses, 'Field used in ' || count(*) || ' queries' AS reason,
 round(count(*) / (SELECT count(*) FROM q), 6) AS impact FROM u WHERE field <> 'level' GROUP BY field
 HAVING count(*) > (SELECT count(*) FROM q) // 10""",
)
def field_index_suggestions(spark, sf_dir):
    queries = table(spark, sf_dir, "events").selectExpr(
        "concat('SELECT * FROM logs WHERE level = ''', event_type, ''' AND user', user_id % 4, ' > 5 AND value >= 1 OR name LIKE ''x''') AS query"
    )
    return index_suggestions(queries, indexed=("level",)).withColumn("impact", F.round("impact", 6))


# -- rollups ----------------------------------------------------------------------------------


@query(
    "service_hourly",
    W
    + """SELECT date_trunc('hour', timestamp) AS hour, service, level, count(*) AS count, count(DISTINCT trace_id) AS unique_traces
 FROM logs GROUP BY 1, 2, 3""",
)
def service_hourly(spark, sf_dir):
    return m.service_hourly(_logs(spark, sf_dir))


_DAILY = """SELECT strftime(timestamp, '%Y-%m-%d') AS day, service, count(*) FILTER (level IN ('error', 'fatal')) AS error_count,
 count(*) FILTER (level = 'warn') AS warn_count, count(*) AS total_count FROM logs GROUP BY 1, 2"""


@query("errors_daily", W + _DAILY)
def errors_daily(spark, sf_dir):
    return m.errors_daily(_logs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(
    "rollup_sketches",
    W + """SELECT CAST(date_trunc('day', timestamp) AS DATE) AS day, service, count(*) AS count, count(DISTINCT trace_id) AS unique_traces, true AS traces_close, true AS p50_close, true AS p95_close
 FROM logs GROUP BY 1, 2""",
)
def rollup_sketches(spark, sf_dir):
    """Hourly sketches united to days, beside the exact numbers: traces within 5 % (three standard errors), quantiles within 5 % of the ranks."""
    logs = _logs(spark, sf_dir)
    day = F.to_date("hour").alias("day")
    estimates = m.sketch_estimates(m.merge_sketches(m.sketch_rollup(logs), day, "service")).withColumnRenamed("unique_traces", "estimate")
    keyed = logs.select(F.to_date("timestamp").alias("day"), "service", "trace_id", F.octet_length("message").alias("length"))
    met = keyed.join(estimates.drop("count", "estimate"), ["day", "service"])
    below = {f"{p}_{side}": F.avg((test(F.col("length"), F.col(p))).cast("double")) for p in ("p50", "p95") for side, test in (("under", lambda a, b: a < b), ("upto", lambda a, b: a <= b))}
    ranks = met.groupBy("day", "service").agg(F.count(F.lit(1)).alias("count"), *[c.alias(n) for n, c in below.items()])
    exact = keyed.groupBy("day", "service").agg(F.count_distinct("trace_id").alias("unique_traces"))
    both = ranks.join(exact, ["day", "service"]).join(estimates.select("day", "service", "estimate"), ["day", "service"])
    close = lambda p, q: ((F.col(f"{p}_under") <= q + 0.05) & (F.col(f"{p}_upto") >= q - 0.05)).alias(f"{p}_close")
    traces = (F.abs(F.col("estimate") - F.col("unique_traces")) <= 0.05 * F.col("unique_traces")).alias("traces_close")
    return both.select("day", "service", "count", "unique_traces", traces, close("p50", 0.5), close("p95", 0.95))


@query(
    "trace_rollup",
    W
    + """, s AS (SELECT trace_id, service, min(timestamp) AS a, max(timestamp) AS b, count(*) AS n,
 count(*) FILTER (level IN ('error', 'fatal')) AS e FROM logs WHERE trace_id <> '' GROUP BY 1, 2)
 SELECT trace_id, min(a) AS start_time, max(b) AS end_time, CAST(sum(n) AS BIGINT) AS span_count, count(*) AS service_count,
 CAST(sum(e) AS BIGINT) AS error_count, string_agg(service || '=' || n, ',' ORDER BY service) AS services FROM s GROUP BY trace_id""",
)
def trace_rollup(spark, sf_dir):
    text = F.transform("service_rows", lambda r: F.concat_ws("=", r["service"], r["rows"].cast("string")))
    return m.trace_rollup(_logs(spark, sf_dir)).select(
        "trace_id", "start_time", "end_time", "span_count", "service_count", "error_count",
        F.array_join(text, ",").alias("services"),
    )


@query(
    "latest_per_key",
    W
    + """SELECT a_user_id AS user_id, timestamp, id, level, message FROM (SELECT *, row_number() OVER (PARTITION BY a_user_id
 ORDER BY timestamp DESC, id DESC) AS rn FROM logs) WHERE rn = 1""",
)
def latest_per_key(spark, sf_dir):
    rows = _logs(spark, sf_dir).select(x.attr("user_id").alias("user_id"), "timestamp", "id", "level", "message")
    return m.latest_per_key(rows, ["user_id"], ["timestamp", "id"])


@query("merge_rollups", W + _DAILY)
def merge_rollups(spark, sf_dir):
    """The rollup of the first half of the month merged with the one of the second half."""
    logs = _logs(spark, sf_dir)
    cut = x.ntz(datetime(2024, 1, 15, 12))
    old, new = (m.errors_daily(logs.filter(c)) for c in (F.col("timestamp") < cut, F.col("timestamp") >= cut))
    merged = m.merge_rollups(old, new, ["day", "service"], ["error_count", "warn_count", "total_count"])
    return merged.withColumn("day", F.col("day").cast("string"))


# -- sorting and pages ------------------------------------------------------------------------


@query("order_by_limit", W + "SELECT id, service, level FROM logs ORDER BY service, id DESC LIMIT 500")
def order_by_limit(spark, sf_dir):
    spec = QuerySpec(
        "ordered", fields=("id", "service", "level"), order_by=(OrderBy("service"), OrderBy("id", "DESC")), limit=500
    )
    return run_query(_logs(spark, sf_dir), spec)


@query("order_by_all", W + "SELECT id, service FROM logs ORDER BY service, id")
def order_by_all(spark, sf_dir):
    return run_query(_logs(spark, sf_dir), QuerySpec("sorted", ("id", "service"), order_by=(OrderBy("service"), OrderBy("id"))))


@query("offset_page", W + "SELECT id, timestamp, level FROM logs ORDER BY timestamp DESC, id DESC LIMIT 101 OFFSET 200")
def offset_page(spark, sf_dir):
    request = p.PageRequest(page_token=p.encode_token(offset=200), sort_by="timestamp")
    return p.offset_rows(_logs(spark, sf_dir).select("id", "timestamp", "level"), request)


@query(
    "keyset_page",
    W
    + """SELECT id, timestamp, level FROM logs WHERE (timestamp, id) < (TIMESTAMP '2024-01-20 00:00:00', 'ev-5')
 ORDER BY timestamp DESC, id DESC LIMIT 101""",
)
def keyset_page(spark, sf_dir):
    logs = stored_logs(spark, sf_dir).select("id", "timestamp", "level", "date_partition")
    return p.keyset_rows(logs, "timestamp", ("2024-01-20 00:00:00", "ev-5"), 100, "DESC").drop("date_partition")


@query("page_total", W + "SELECT count(*) AS total_count FROM logs WHERE level = 'error'")
def page_total(spark, sf_dir):
    return p.total_count(_logs(spark, sf_dir).filter(F.col("level") == "error"))


@query(
    "full_text_search",
    W
    + """SELECT timestamp, level, service, message FROM logs WHERE contains(lower(message), 'timeout')
 ORDER BY timestamp DESC, id DESC LIMIT 10""",
)
def full_text_search(spark, sf_dir):
    return t.full_text_search(_logs(spark, sf_dir), AS_OF, "TIMEOUT", days=31)


@query(
    "recent_errors",
    W
    + f"""SELECT timestamp, level, message, a_exception AS exception, a_exception_message AS error_message FROM logs
 WHERE service = '{SPRING}' AND level IN ('ERROR', 'WARN') ORDER BY timestamp DESC, id DESC LIMIT 50""",
)
def recent_errors(spark, sf_dir):
    return t.recent_errors(_logs(spark, sf_dir), AS_OF, SPRING, hours=ALL_HOURS)


@query(
    "latest_system_metrics",
    W
    + f"""SELECT timestamp, a_max_memory_bytes AS max_memory_mb, a_used_memory_bytes AS used_memory_mb, a_memory_usage_percent AS memory_percent,
 a_available_processors AS cpu_cores FROM logs WHERE service = '{SPRING}' AND a_metric_type = 'system' ORDER BY timestamp DESC, id DESC LIMIT 10""",
)
def latest_system_metrics(spark, sf_dir):
    return t.latest_system_metrics(_logs(spark, sf_dir), SPRING)


@query("high_memory_periods", W + f"SELECT timestamp, a_memory_usage_percent AS memory_pct FROM logs WHERE service = '{SPRING}' AND TRY_CAST(a_memory_usage_percent AS DOUBLE) > 80")
def high_memory_periods(spark, sf_dir):
    return t.high_memory_periods(_logs(spark, sf_dir), SPRING)


@query("last_rows", W + "SELECT id, timestamp, message FROM logs ORDER BY timestamp DESC, id DESC LIMIT 1000")
def last_rows(spark, sf_dir):
    return t.last_rows(_logs(spark, sf_dir).select("id", "timestamp", "message"), 1000)


# -- scalar functions -------------------------------------------------------------------------


@query(
    "time_functions",
    W
    + """SELECT id, date_trunc('minute', timestamp) AS minute, date_trunc('hour', timestamp) AS hour, strftime(timestamp, '%Y-%m-%d') AS day,
 CAST(hour(timestamp) AS INT) AS hour_of_day, strftime(timestamp, '%Y%m%d') AS daily, strftime(timestamp, '%G%V') AS weekly,
 strftime(timestamp, '%Y%m') AS monthly, strftime(timestamp, '%Y%m%d%H') AS hourly FROM logs""",
)
def time_functions(spark, sf_dir):
    ts = "timestamp"
    return _logs(spark, sf_dir).select(
        "id",
        x.start_of_minute(ts).alias("minute"),
        x.start_of_hour(ts).alias("hour"),
        x.day(ts).cast("string").alias("day"),
        x.hour(ts).alias("hour_of_day"),
        *[x.partition_key(ts, i).alias(i) for i in ("daily", "weekly", "monthly", "hourly")],
    )


@query(
    "order_week_partitions",
    "SELECT strftime(o_orderdate, '%G%V') AS week, count(*) AS n FROM orders GROUP BY 1",
)
def order_week_partitions(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(x.partition_key("o_orderdate", "weekly").alias("week")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "text_functions",
    W
    + """SELECT id, CASE level WHEN 'debug' THEN 1 WHEN 'info' THEN 2 WHEN 'warn' THEN 3 WHEN 'error' THEN 4 WHEN 'fatal' THEN 5
 ELSE 0 END AS level_numeric, contains(lower(message), 'http') AS mentions_http, CAST(strlen(message) AS INT) AS message_bytes,
 lower(level) AS level_lower, CAST(k AS VARCHAR) AS k_text,
 array_to_string(string_split_regex(trim(message), '\\s+')[1:3], ' ') AS first_words FROM logs""",
)
def text_functions(spark, sf_dir):
    return _logs(spark, sf_dir).select(
        "id",
        x.level_rank("level").alias("level_numeric"),
        x.contains_ignore_case("message", "HTTP").alias("mentions_http"),
        x.byte_length("message").alias("message_bytes"),
        F.lower("level").alias("level_lower"),
        x.first_words("message").alias("first_words"),
    ).join(
        table(spark, sf_dir, "events").select(
            F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("id"),
            x.json_field("props", "$.k").alias("k_text"),
        ),
        "id",
    )


_SIZE = """CASE WHEN s >= 1099511627776 THEN printf('%.2f TiB', round(s / 1099511627776, 2)) WHEN s >= 1073741824 THEN
 printf('%.2f GiB', round(s / 1073741824, 2)) WHEN s >= 1048576 THEN printf('%.2f MiB', round(s / 1048576, 2)) WHEN s >= 1024 THEN
 printf('%.2f KiB', round(s / 1024, 2)) ELSE printf('%.2f B', s) END"""


@query(
    "display_functions",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_orderkey AS s, l_extendedprice * l_linenumber * l_linenumber AS m FROM lineitem)
 SELECT l_orderkey, l_linenumber, {_SIZE} AS size, CASE WHEN m >= 1000000 THEN printf('%.1fM', round(m / 1000000, 1))
 WHEN m >= 1000 THEN printf('%.1fK', round(m / 1000, 1)) ELSE regexp_replace(printf('%.3f', round(m, 3)), '\\.?0+$', '') END AS short,
 round(s / 7, 2) AS rounded FROM v""",
)
def display_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {
            "s": F.col("l_extendedprice") * F.col("l_orderkey"),
            "m": F.col("l_extendedprice") * F.col("l_linenumber") * F.col("l_linenumber"),
        }
    )
    return rows.select(
        "l_orderkey", "l_linenumber", x.readable_size("s").alias("size"), x.short_number("m").alias("short"),
        F.round(F.col("s") / 7, 2).alias("rounded"),
    )


# -- charts -----------------------------------------------------------------------------------

_COUNTS_SQL = "SELECT service, count(*) AS total, count(*) FILTER (level = 'error') AS errors, max(level) AS top_level FROM logs GROUP BY service"


def _service_counts(spark, sf_dir):
    return _logs(spark, sf_dir).groupBy("service").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "error").alias("errors"), F.max("level").alias("top_level")
    )


@query(
    "chart_data",
    W
    + f""", c AS ({_COUNTS_SQL}) SELECT service AS label, 'total' AS series, CAST(total AS DOUBLE) AS value FROM c UNION ALL
 SELECT service, 'errors', CAST(errors AS DOUBLE) FROM c UNION ALL SELECT service, 'top_level', 0.0 FROM c""",
)
def chart_data(spark, sf_dir):
    return d.chart_data(_service_counts(spark, sf_dir))


@query("pie_data", W + f", c AS ({_COUNTS_SQL}) SELECT service AS label, CAST(total AS DOUBLE) AS value FROM c")
def pie_data(spark, sf_dir):
    return d.pie_data(_service_counts(spark, sf_dir))


@query(
    "scatter_data",
    W
    + f""", c AS ({_COUNTS_SQL}), n AS (SELECT row_number() OVER (ORDER BY service) - 1 AS x, * FROM c)
 SELECT x, 'total' AS series, CAST(total AS DOUBLE) AS value FROM n UNION ALL SELECT x, 'errors', CAST(errors AS DOUBLE) FROM n""",
)
def scatter_data(spark, sf_dir):
    return d.scatter_data(_service_counts(spark, sf_dir).drop("top_level"), "service")


@query("metric_data", W + "SELECT CAST(count(*) AS DOUBLE) AS value, 'Errors' AS label FROM logs WHERE level = 'error'")
def metric_data(spark, sf_dir):
    spec = QuerySpec("errors", filters=[Filter("level", "equals", "error")], aggregations=(Aggregation("COUNT", alias="n"),))
    return widget_data(_logs(spark, sf_dir), Widget("Errors", "metric", spec=spec), AS_OF)


@query("metric_data_empty", "SELECT 0.0::DOUBLE AS value, 'None' AS label")
def metric_data_empty(spark, sf_dir):
    sql = "SELECT count(*) AS n FROM logs WHERE level = :level GROUP BY level"
    return widget_data(_logs(spark, sf_dir), Widget("None", "metric", sql=sql, parameters={"level": "no such level"}), AS_OF)


@query("widget_saved_query", W + "SELECT service AS label, 'error_count' AS series, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE level = 'error' GROUP BY 1 UNION ALL SELECT service, 'unique_requests', CAST(count(DISTINCT trace_id) AS DOUBLE) FROM logs WHERE level = 'error' GROUP BY 1")
def widget_saved_query(spark, sf_dir):
    widget = Widget("Errors", "chart", saved="errors_by_service", parameters={"hours": ALL_HOURS, "limit": 100})
    return widget_data(_logs(spark, sf_dir), widget, AS_OF)


@query("table_widget", W + "SELECT service, count(*) AS total FROM logs GROUP BY service ORDER BY total DESC, service LIMIT 5")
def table_widget(spark, sf_dir):
    rows = _service_counts(spark, sf_dir).select("service", "total").orderBy(F.col("total").desc(), "service")
    return d.table_rows(rows, 5)


@query("counts_by_timestamp", W + "SELECT timestamp, count(*) AS count FROM logs GROUP BY timestamp")
def counts_by_timestamp(spark, sf_dir):
    return t.counts_by_timestamp(_logs(spark, sf_dir), AS_OF, hours=ALL_HOURS)
