"""Error detection."""

from pyspark.sql import functions as F

from ridgelog.catalog.registry import query
from ridgelog.catalog.tables import AS_OF, DOCUMENT_LOGS, LOGS, document_logs, event_logs
from ridgelog.functions.patterns import ERROR_LEVELS, ERROR_PATTERNS
from ridgelog.operators import errors as e

_LEVELS = "(" + ", ".join(f"'{level}'" for level in ERROR_LEVELS) + ")"


def hits_sql(logs: str, error: str = "a_error", status: str = "a_status_code") -> str:
    """Common table expressions ``logs`` and ``hits`` (id, position, tag, category, pattern)."""
    arms = [
        f"""SELECT id, 0 AS position, 'level:' || level AS tag, level AS category, 'LogLevel' AS pattern FROM logs
 WHERE lower(level) IN {_LEVELS}"""
    ]
    for i, (name, category, pattern, _) in enumerate(ERROR_PATTERNS, start=1):
        text = pattern.replace("'", "''")
        arms.append(f"SELECT id, {i}, '{category}:{name}', '{category}', '{name}' FROM logs WHERE regexp_matches(message, '{text}')")
    if error:
        arms.append(f"SELECT id, 20, 'attribute:error', 'attribute', 'AttributeError' FROM logs WHERE {error} <> ''")
        arms.append(
            f"""SELECT id, 21, 'http:' || CAST({status} AS INT), CASE WHEN CAST({status} AS INT) >= 500 THEN 'http5xx' ELSE 'http4xx' END,
 'HTTP' || CAST({status} AS INT) FROM logs WHERE TRY_CAST({status} AS INT) >= 400"""
        )
    return logs + ", hits AS (" + " UNION ALL ".join(arms) + "), found AS (SELECT h.*, l.timestamp, l.service, l.message, l.trace_id FROM hits h JOIN logs l USING (id))"


_HITS = hits_sql(LOGS)
_DOCUMENT_HITS = hits_sql(DOCUMENT_LOGS, "")
_TAGS = """ SELECT l.id, coalesce(string_agg(h.tag, ',' ORDER BY h.position), '') AS detected_errors FROM logs l LEFT JOIN hits h USING (id) GROUP BY l.id"""
_STATS = f"""{_HITS}, counts AS (SELECT category, pattern, service, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
 FROM found GROUP BY 1, 2, 3), totals AS (SELECT category, pattern, CAST(sum(count) AS BIGINT) AS count, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
 string_agg(service || '=' || count, ',' ORDER BY service) AS services FROM counts GROUP BY 1, 2),
 rated AS (SELECT *, CASE WHEN last_seen > first_seen THEN count / ((epoch_us(last_seen) - epoch_us(first_seen)) / 60e6) ELSE 0.0 END AS rate,
 count / ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(first_seen)) / 60e6) AS current_rate FROM totals),
 stats AS (SELECT *, CASE WHEN last_seen < TIMESTAMP '2024-01-30 23:55:00' THEN 'stable' WHEN rate > current_rate * 1.2 THEN 'increasing'
 WHEN rate < current_rate * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM rated)"""


def _tagged(logs):
    return e.with_detected_errors(logs).select("id", F.array_join("detected_errors", ",").alias("detected_errors"))


def _stats(spark, sf_dir):
    return e.error_statistics(e.error_counts(event_logs(spark, sf_dir)), AS_OF)


@query("error_tags", f"WITH {_HITS}{_TAGS}")
def error_tags(spark, sf_dir):
    return _tagged(event_logs(spark, sf_dir))


@query("error_tags_documents", f"WITH {_DOCUMENT_HITS}{_TAGS}")
def error_tags_documents(spark, sf_dir):
    return _tagged(document_logs(spark, sf_dir))


@query("error_counts", f"WITH {_STATS} SELECT * FROM counts")
def error_counts(spark, sf_dir):
    return e.error_counts(event_logs(spark, sf_dir))


@query(
    "error_counts_documents",
    f"WITH {_DOCUMENT_HITS} SELECT category, pattern, service, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM found GROUP BY 1, 2, 3",
)
def error_counts_documents(spark, sf_dir):
    return e.error_counts(document_logs(spark, sf_dir))


@query(
    "error_statistics",
    f"WITH {_STATS} SELECT category, pattern, count, first_seen, last_seen, services, round(rate, 6) AS rate, round(current_rate, 6) AS current_rate, trend FROM stats",
)
def error_statistics(spark, sf_dir):
    services = F.transform(
        F.array_sort(F.map_entries("services")), lambda r: F.concat_ws("=", r["key"], r["value"].cast("string"))
    )
    return _stats(spark, sf_dir).withColumns(
        {
            "services": F.array_join(services, ","),
            "rate": F.round("rate", 6),
            "current_rate": F.round("current_rate", 6),
        }
    )


@query(
    "error_samples",
    f"""WITH {_HITS} SELECT category, pattern, CAST(rn AS INT) AS sample, id AS log_id, timestamp, service, message, trace_id FROM (SELECT *, row_number() OVER
 (PARTITION BY category, pattern ORDER BY timestamp, id) AS rn FROM found) WHERE rn <= 10""",
)
def error_samples(spark, sf_dir):
    return e.error_samples(event_logs(spark, sf_dir))


@query(
    "error_trends",
    f"""WITH {_STATS} SELECT category, CAST(sum(count) AS BIGINT) AS total_errors, round(avg(rate), 6) AS avg_rate, count(*) AS patterns,
 count(*) FILTER (trend = 'increasing') AS increasing, count(*) FILTER (trend = 'decreasing') AS decreasing FROM stats GROUP BY category""",
)
def error_trends(spark, sf_dir):
    return e.trends_by_category(_stats(spark, sf_dir)).withColumn("avg_rate", F.round("avg_rate", 6))


@query(
    "high_rate_alerts",
    f"""WITH {_STATS} SELECT 'high_error_rate' AS type, category || ':' || pattern AS pattern, category, round(rate, 6) AS current_rate,
 0.01::DOUBLE AS threshold, 'warning' AS severity, printf('Error rate %.2f/min exceeds threshold 0.01/min', rate) AS message FROM stats WHERE rate > 0.01""",
)
def high_rate_alerts(spark, sf_dir):
    return e.high_rate_alerts(_stats(spark, sf_dir), 0.01).withColumn("current_rate", F.round("current_rate", 6))


_MINUTES = f"""{_HITS}, minutes AS (SELECT service, date_trunc('minute', timestamp) AS minute, count(DISTINCT id) AS errors FROM found GROUP BY 1, 2)"""


@query("errors_per_minute", f"WITH {_MINUTES} SELECT * FROM minutes")
def errors_per_minute(spark, sf_dir):
    return e.errors_per_minute(event_logs(spark, sf_dir))


_SCORED = f"""{_MINUTES}, scored AS (SELECT *, count(*) OVER w AS points, avg(errors) OVER w AS mean, stddev_samp(errors) OVER w AS std_dev FROM minutes
 WINDOW w AS (PARTITION BY service ORDER BY minute ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""


@query(
    "error_z_scores",
    f"""WITH {_SCORED} SELECT service, minute, errors, points, round(mean, 6) AS mean,
 round(CASE WHEN points >= 10 AND std_dev > 1e-9 THEN (errors - mean) / std_dev ELSE 0 END, 5) AS z_score,
 points >= 10 AND std_dev > 1e-9 AND abs((errors - mean) / std_dev) > 2 AS is_anomaly FROM scored""",
)
def error_z_scores(spark, sf_dir):
    scored = e.with_z_score(e.errors_per_minute(event_logs(spark, sf_dir)), "errors", ["service"], "minute")
    return scored.withColumns(
        {"mean": F.round("mean", 6), "z_score": F.round(F.coalesce("z_score", F.lit(0.0)), 5)}
    ).drop("std_dev")


@query(
    "error_anomalies",
    f"""WITH {_SCORED} SELECT service, minute, errors, round((errors - mean) / std_dev, 5) AS z_score FROM scored
 WHERE points >= 10 AND std_dev > 1e-9 AND abs((errors - mean) / std_dev) > 2""",
)
def error_anomalies(spark, sf_dir):
    return e.anomalies(event_logs(spark, sf_dir)).select("service", "minute", "errors", F.round("z_score", 5).alias("z_score"))


@query("live_error_statistics", f"WITH {_STATS} SELECT category, pattern, count, last_seen FROM stats WHERE last_seen >= TIMESTAMP '2024-01-30'")
def live_error_statistics(spark, sf_dir):
    return e.live_statistics(_stats(spark, sf_dir), AS_OF).select("category", "pattern", "count", "last_seen")


@query(
    "error_category_distribution",
    f"""WITH {_STATS} SELECT category, CAST(sum(count) AS BIGINT) AS errors, round(sum(count) / (SELECT sum(count) FROM stats), 6) AS share FROM stats GROUP BY category""",
)
def error_category_distribution(spark, sf_dir):
    return e.category_distribution(_stats(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("error_totals", f"WITH {_STATS} SELECT CAST(sum(count) AS BIGINT) AS total_errors, count(*) AS patterns, count(DISTINCT category) AS categories FROM stats")
def error_totals(spark, sf_dir):
    return e.error_totals(_stats(spark, sf_dir))


@query("top_error_rates", f"WITH {_STATS} SELECT category, pattern, round(rate, 6) AS rate FROM stats ORDER BY stats.rate DESC, category, pattern LIMIT 10")
def top_error_rates(spark, sf_dir):
    return e.top_by_rate(_stats(spark, sf_dir)).select("category", "pattern", F.round("rate", 6).alias("rate"))
