"""Histograms, rates, snapshots, health and alerts."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgelog.catalog.registry import query
from ridgelog.catalog.tables import LOGS, event_logs, table
from ridgelog.functions.scalars import attr
from ridgelog.operators import alerts as a
from ridgelog.operators import metrics as k
from ridgelog.operators.alerts import AlertRule
from ridgelog.session import scratch_path
from ridgelog.streaming.jobs import run_available, stream_files

_BOUNDS = (0.1, 0.5, 1, 5, 10, 50, 100, 500, 1000)
_BUCKET = "CASE " + " ".join(f"WHEN v <= {b} THEN {i}" for i, b in enumerate(_BOUNDS)) + " ELSE 9 END"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(
    "histogram_buckets",
    f"""SELECT event_type, CAST(events_b.bucket AS INT) AS bucket, count(*) AS count, CASE events_b.bucket {' '.join(f'WHEN {i} THEN {float(b)}' for i, b in enumerate(_BOUNDS))}
 ELSE 'inf'::DOUBLE END::DOUBLE AS upper_bound FROM (SELECT event_type, {_BUCKET.replace('v <=', 'value <=')} AS bucket FROM events) AS events_b GROUP BY event_type, events_b.bucket""",
)
def histogram_buckets(spark, sf_dir):
    return k.histogram(_events(spark, sf_dir), "value", ["event_type"])


def _stats_sql(source: str, value: str, key: str) -> str:
    """Bucketed percentiles from a running sum over the buckets, per value of ``key``."""
    bound = "CASE b " + " ".join(f"WHEN {i} THEN {float(x)}::DOUBLE" for i, x in enumerate(_BOUNDS)) + " ELSE hi END"
    reached = ", ".join(
        f"arg_min(bound, b) FILTER (cum >= CAST(trunc(n * {p}::DOUBLE) AS BIGINT)) AS {name}"
        for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))
    )
    return f"""s AS (SELECT {key} AS key, {value} AS v FROM {source}),
 t AS (SELECT key, count(*) AS n, sum(v) AS sum, min(v) AS lo, max(v) AS hi FROM s GROUP BY key),
 c AS (SELECT key, {_BUCKET} AS b, count(*) AS m FROM s GROUP BY 1, 2), g AS (SELECT t.*, unnest(range(10)) AS b FROM t),
 r AS (SELECT key, n, sum, lo, hi, b, {bound} AS bound, sum(coalesce(m, 0)) OVER (PARTITION BY key ORDER BY b) AS cum FROM g LEFT JOIN c USING (key, b)),
 stats AS (SELECT key, n AS count, sum, lo AS min, hi AS max, {reached} FROM r GROUP BY key, n, sum, lo, hi)"""


@query(
    "histogram_statistics",
    f"""WITH {_stats_sql('events', 'value', 'event_type')} SELECT key AS event_type, count, round(sum, 4) AS sum, round(sum / count, 6) AS avg, min, max, p50, p90, p99 FROM stats""",
)
def histogram_statistics(spark, sf_dir):
    stats = k.histogram_stats(_events(spark, sf_dir), "value", ["event_type"])
    return stats.withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@query(
    "histogram_line_prices",
    f"""WITH {_stats_sql('lineitem', 'l_extendedprice / 100', 'l_returnflag')} SELECT key AS l_returnflag, count, round(sum, 2) AS sum, round(sum / count, 4) AS avg, min, max, p50, p90, p99 FROM stats""",
)
def histogram_line_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") / 100)
    stats = k.histogram_stats(rows, "v", ["l_returnflag"])
    return stats.withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 4)})


_RATE = """SELECT {keys}make_timestamp(second * 1000000) AS second, events, round(sum(events) OVER ({part}ORDER BY second RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)
 / {w}, 6) AS rate FROM (SELECT {keys}epoch_us(ts) // 1000000 AS second, count(*) AS events FROM events GROUP BY {keys}2)"""


@query("sliding_rate", _RATE.format(keys="", part="", n=59, w="60.0").replace("GROUP BY 2", "GROUP BY 1"))
def sliding_rate(spark, sf_dir):
    return k.sliding_rate(_events(spark, sf_dir), ts="ts").withColumn("rate", F.round("rate", 6))


@query("sliding_rate_by_type", _RATE.format(keys="event_type, ", part="PARTITION BY event_type ", n=3599, w="3600.0"))
def sliding_rate_by_type(spark, sf_dir):
    return k.sliding_rate(_events(spark, sf_dir), ["event_type"], 3600, ts="ts").withColumn("rate", F.round("rate", 6))


_SAMPLED = """sampled AS (SELECT event_type, epoch_us(ts) // 300000000 * 300 AS "at", arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)"""


def _samples(spark, sf_dir):
    return k.sample_series(_events(spark, sf_dir), ["event_type"], "value", 300, ts="ts", tie="event_id")


@query("sampled_series", f"WITH {_SAMPLED} SELECT * FROM sampled")
def sampled_series(spark, sf_dir):
    return _samples(spark, sf_dir)


@query(
    "counter_increase",
    f"""WITH {_SAMPLED}, stepped AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w
 ELSE value END AS step FROM sampled WINDOW w AS (PARTITION BY event_type ORDER BY "at"))
 SELECT event_type, "at", value, round(sum(step) OVER w2, 4) AS increase, round(sum(step) OVER w2 / 3600, 6) AS rate FROM stepped
 WINDOW w2 AS (PARTITION BY event_type ORDER BY "at" RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)""",
)
def counter_increase(spark, sf_dir):
    rows = k.counter_increase(_samples(spark, sf_dir), ["event_type"], 3600)
    return rows.withColumns({"increase": F.round("increase", 4), "rate": F.round("rate", 6)})


@query(
    "failure_ratio",
    """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS bucket, count(*) FILTER (event_type = 'error') AS failures, count(*) AS total,
 round(count(*) FILTER (event_type = 'error') / count(*) * 100, 6) AS failure_percent FROM events GROUP BY 1, 2""",
)
def failure_ratio(spark, sf_dir):
    rows = k.failure_ratio(_events(spark, sf_dir), F.col("event_type") == "error", ["user_id"], "1 day", "ts")
    return rows.withColumn("failure_percent", F.round("failure_percent", 6))


@query(
    "condition_holds",
    f"""WITH {_SAMPLED}, f AS (SELECT *, min(CASE WHEN value > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY "at" RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS held,
 min("at") OVER (PARTITION BY event_type) AS first FROM sampled) SELECT event_type, "at", value, held = 1 AND "at" - first >= 3600 AS firing FROM f""",
)
def condition_holds(spark, sf_dir):
    return k.holds_for(_samples(spark, sf_dir), ["event_type"], F.col("value") > 5, 3600)


def _snapshot(spark, sf_dir):
    events = _events(spark, sf_dir)
    return k.metric_snapshot(
        events,
        "value",
        counters={
            "total_logs_ingested": F.count(F.lit(1)),
            "failed_ingestions_total": F.count_if(F.col("event_type") == "error"),
        },
        gauges={"largest_value": F.max("value")},
    )


_SNAPSHOT = f"""{_stats_sql('events', 'value', '1')}, snapshot AS (SELECT 'total_logs_ingested' AS name, 'counter' AS type, count(*)::DOUBLE AS value FROM events
 UNION ALL SELECT 'failed_ingestions_total', 'counter', (count(*) FILTER (event_type = 'error'))::DOUBLE FROM events
 UNION ALL SELECT 'largest_value', 'gauge', max(value) FROM events
 UNION ALL SELECT 'query_duration_ms_count', 'gauge', count::DOUBLE FROM stats UNION ALL SELECT 'query_duration_ms_sum', 'gauge', sum FROM stats
 UNION ALL SELECT 'query_duration_ms_avg', 'gauge', sum / count FROM stats UNION ALL SELECT 'query_duration_ms_min', 'gauge', min FROM stats
 UNION ALL SELECT 'query_duration_ms_max', 'gauge', max FROM stats UNION ALL SELECT 'query_duration_ms_p50', 'gauge', p50 FROM stats
 UNION ALL SELECT 'query_duration_ms_p90', 'gauge', p90 FROM stats UNION ALL SELECT 'query_duration_ms_p99', 'gauge', p99 FROM stats)"""


@query("metric_snapshot", f"WITH {_SNAPSHOT} SELECT name, type, round(value, 4) AS value FROM snapshot")
def metric_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir).withColumn("value", F.round("value", 4))


@query(
    "component_health",
    f"""WITH {_SNAPSHOT} SELECT 'ingestion' AS component, CASE WHEN value = 0 THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN value = 0 THEN 'No logs have been ingested'
 ELSE '' END AS message FROM snapshot WHERE name = 'total_logs_ingested' UNION ALL SELECT 'query_engine', CASE WHEN value > 50 THEN 'degraded' ELSE 'ok' END,
 CASE WHEN value > 50 THEN 'Query performance is degraded' ELSE '' END FROM snapshot WHERE name = 'query_duration_ms_p99'""",
)
def component_health(spark, sf_dir):
    return k.health(_snapshot(spark, sf_dir), slow_ms=50.0)


#: rules over hourly metrics of the events
RULES = (
    AlertRule("busy_hour", "warning", "events_per_hour", ">", 15.0, 10800),
    AlertRule("quiet_hour", "info", "events_per_hour", "<", 11.0, 21600),
    AlertRule("large_value", "critical", "max_value", ">", 120.0, 7200),
    AlertRule("exact_hour", "info", "events_per_hour", "=", 14.0, 0),
)


def _hourly_metrics(spark, sf_dir):
    at = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3600).cast("bigint")
    hourly = _events(spark, sf_dir).groupBy(at.alias("at")).agg(
        F.count(F.lit(1)).cast("double").alias("events_per_hour"), F.max("value").alias("max_value")
    )
    return hourly.unpivot("at", ["events_per_hour", "max_value"], "name", "value")


_CHECKS = """hourly AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS "at", count(*) AS n, max(value) AS m FROM events GROUP BY 1),
 checks AS (SELECT 'busy_hour' AS rule, 'warning' AS severity, 10800 AS cooldown, "at", n::DOUBLE AS value, n > 15 AS triggered FROM hourly
 UNION ALL SELECT 'quiet_hour', 'info', 21600, "at", n, n < 11 FROM hourly UNION ALL SELECT 'large_value', 'critical', 7200, "at", m, m > 120 FROM hourly
 UNION ALL SELECT 'exact_hour', 'info', 0, "at", n, n = 14 FROM hourly)"""


_DEFAULT_SAMPLES = """m AS (SELECT event_id AS "at", user_id % 4 AS kind, value AS v FROM events), s AS (SELECT "at", CASE kind WHEN 0 THEN 'ingestion_rate_per_second' WHEN 1 THEN 'query_duration_ms_p99'
 WHEN 2 THEN 'memory_alloc_mb' ELSE 'storage_free_percent' END AS name, CASE WHEN kind = 0 AND "at" % 3 = 0 THEN 0 ELSE floor(v) * CASE kind WHEN 0 THEN 100 WHEN 1 THEN 50 WHEN 2 THEN 10 ELSE 1 END END AS value FROM m)"""


@query(
    "default_alerts",
    f"""WITH {_DEFAULT_SAMPLES}, r(rule, severity, metric, comparator, threshold, cooldown) AS (VALUES ('high_ingestion_rate', 'warning', 'ingestion_rate_per_second', '>', 10000.0, 300), ('slow_queries', 'warning', 'query_duration_ms_p99', '>', 5000.0, 300),
 ('high_memory_usage', 'critical', 'memory_alloc_mb', '>', 1024.0, 300), ('low_storage_space', 'critical', 'storage_free_percent', '<', 10.0, 1800), ('no_recent_logs', 'info', 'ingestion_rate_per_second', '=', 0.0, 600))
 SELECT rule, severity, cooldown, "at", value, CASE comparator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold ELSE value = threshold END AS triggered FROM s JOIN r ON name = metric""",
)
def default_alerts(spark, sf_dir):
    """The default rules on one sample per event."""
    return a.evaluate_rules(_default_samples(spark, sf_dir))


@query(
    "alert_messages",
    f"""WITH {_DEFAULT_SAMPLES} SELECT "at", CASE name WHEN 'ingestion_rate_per_second' THEN printf('Ingestion rate is %.0f logs/sec (threshold: 10000)', value)
 WHEN 'query_duration_ms_p99' THEN printf('99th percentile query duration is %.0fms (threshold: 5000ms)', value) WHEN 'memory_alloc_mb' THEN printf('Memory usage is %.0fMB (threshold: 1024MB)', value)
 ELSE printf('Only %.1f%% storage space remaining', value) END AS message FROM s WHERE CASE name WHEN 'ingestion_rate_per_second' THEN value > 10000 WHEN 'query_duration_ms_p99' THEN value > 5000
 WHEN 'memory_alloc_mb' THEN value > 1024 ELSE value < 10 END""",
)
def alert_messages(spark, sf_dir):
    checks = a.evaluate_rules(_default_samples(spark, sf_dir), a.DEFAULT_RULES[:4])
    return a.alert_messages(checks).select("at", "message")


def _default_samples(spark, sf_dir):
    kind = F.col("user_id") % 4
    name = F.element_at(F.array(*[F.lit(n) for n in ("ingestion_rate_per_second", "query_duration_ms_p99", "memory_alloc_mb", "storage_free_percent")]), (kind + 1).cast("int"))
    scale = F.element_at(F.array(*[F.lit(float(n)) for n in (100, 50, 10, 1)]), (kind + 1).cast("int"))
    value = F.when((kind == 0) & (F.col("event_id") % 3 == 0), F.lit(0.0)).otherwise(F.floor("value") * scale)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), name.alias("name"), value.alias("value"))


@query("alert_checks", f"WITH {_CHECKS} SELECT * FROM checks")
def alert_checks(spark, sf_dir):
    return a.evaluate_rules(_hourly_metrics(spark, sf_dir), RULES)


@query(
    "alert_episodes",
    f"""WITH {_CHECKS}, runs AS (SELECT *, sum(CASE WHEN triggered THEN 0 ELSE 1 END) OVER w AS run, lead("at") OVER w AS nxt FROM checks
 WINDOW w AS (PARTITION BY rule ORDER BY "at")) SELECT rule, severity, min("at") AS start_at, max("at") AS last_at, arg_max(coalesce(nxt, -1), "at") AS end_at,
 count(*) AS count FROM runs WHERE triggered GROUP BY rule, severity, run""",
)
def alert_episodes(spark, sf_dir):
    checks = a.evaluate_rules(_hourly_metrics(spark, sf_dir), RULES)
    return a.episodes(checks).withColumn("end_at", F.coalesce("end_at", F.lit(-1)))


_WALK = f"""RECURSIVE {_CHECKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY "at") AS rn FROM checks),
 walk AS (SELECT rule, severity, rn, "at", triggered, true AS evaluated, CASE WHEN triggered THEN "at" + cooldown ELSE 0 END AS quiet, triggered AS active,
 CASE WHEN triggered THEN 1 ELSE 0 END AS episode, false AS closes FROM numbered WHERE rn = 1
 UNION ALL SELECT n.rule, n.severity, n.rn, n."at", n.triggered, n."at" >= w.quiet, CASE WHEN n."at" >= w.quiet AND n.triggered THEN n."at" + n.cooldown ELSE w.quiet END,
 CASE WHEN n."at" >= w.quiet THEN n.triggered ELSE w.active END, w.episode + CASE WHEN n."at" >= w.quiet AND n.triggered AND NOT w.active THEN 1 ELSE 0 END,
 n."at" >= w.quiet AND NOT n.triggered AND w.active FROM walk w JOIN numbered n ON n.rule = w.rule AND n.rn = w.rn + 1),
 found AS (SELECT rule, severity, min("at") FILTER (evaluated AND triggered) AS start_at,
 coalesce(min("at") FILTER (closes), max("at") FILTER (evaluated AND triggered)) AS last_at, coalesce(min("at") FILTER (closes), -1) AS end_at,
 count(*) FILTER (evaluated AND triggered) AS count FROM walk WHERE episode > 0 GROUP BY rule, severity, episode)"""


def _alerts(spark, sf_dir):
    return a.episodes_with_cooldown(a.evaluate_rules(_hourly_metrics(spark, sf_dir), RULES))


@query("alert_cooldown", f"WITH {_WALK} SELECT * FROM found")
def alert_cooldown(spark, sf_dir):
    return _alerts(spark, sf_dir).withColumn("end_at", F.coalesce("end_at", F.lit(-1)))


@query("stream_alerts", f"WITH {_WALK} SELECT * FROM found")
def stream_alerts(spark, sf_dir):
    """The same alerts from a stream of hourly samples that come in three deliveries, the latest hash first.

    A last file carries the watermark past all samples, as later samples would.
    """
    path, late = scratch_path(spark, "samples"), "40 days"
    metrics = _hourly_metrics(spark, sf_dir)
    for part in (2, 0, 1):
        metrics.where(F.pmod(F.xxhash64("at"), F.lit(3)) == part).write.mode("append").parquet(path)
    mark = spark.createDataFrame([(4_000_000_000, RULES[0].metric, -1.0)], "at bigint, name string, value double")
    mark.coalesce(1).write.mode("append").parquet(path)
    samples = stream_files(spark, path, StructType.fromDDL("at bigint, name string, value double"), files_per_trigger=8)
    versions = run_available(a.episode_stream(a.evaluate_rules(samples, RULES), late), "alerts", state_machine=True)
    return a.latest_episodes(versions).withColumn("end_at", F.coalesce("end_at", F.lit(-1)))


@query("active_alerts", f"WITH {_WALK} SELECT rule, severity, start_at, last_at, count FROM found WHERE end_at = -1")
def active_alerts(spark, sf_dir):
    return a.active_alerts(_alerts(spark, sf_dir)).drop("end_at")


@query(
    "metric_log_alerts",
    f"""WITH {LOGS}, m AS (SELECT timestamp, TRY_CAST(a_memory_usage_percent AS DOUBLE) AS v FROM logs WHERE a_metric_type = 'system')
 SELECT epoch_us(timestamp) AS "at", v AS value, v > 90 AS triggered FROM m""",
)
def metric_log_alerts(spark, sf_dir):
    """An alert rule over a metric that arrives as log attributes."""
    rows = event_logs(spark, sf_dir).select(
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"),
        attr("metric_type").alias("kind"),
        attr("memory_usage_percent").try_cast("double").alias("value"),
    )
    samples = rows.filter(F.col("kind") == "system").select("at", "value", F.lit("memory_percent").alias("name"))
    rule = AlertRule("memory", "critical", "memory_percent", ">", 90.0, 300)
    return a.evaluate_rules(samples, [rule]).select("at", "value", "triggered")
