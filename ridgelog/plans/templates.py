"""Saved queries and dashboard queries over the ``logs`` table.

Attributes are projected before they are aggregated: the optimizer then reads
single keys instead of building maps. Every query takes ``as_of``.
"""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.functions.scalars import (
    attr,
    attr_double,
    attr_long,
    before,
    contains_ignore_case,
    interval_bucket,
    start_of_hour,
    start_of_minute,
)
from ridgelog.operators.filters import time_filter


def _recent(df: DataFrame, as_of: datetime, **span) -> DataFrame:
    """Rows of the last span; older days of a stored table are not read."""
    return time_filter(df, as_of - timedelta(**span), None)


def errors_by_service(df: DataFrame, as_of: datetime, hours: int = 24, limit: int = 20) -> DataFrame:
    """Errors and distinct trace ids per service; '' counts as a trace id."""
    rows = _recent(df.filter(F.col("level") == "error"), as_of, hours=hours)
    grouped = rows.groupBy("service").agg(
        F.count(F.lit(1)).alias("error_count"), F.count_distinct("trace_id").alias("unique_requests")
    )
    return grouped.orderBy(F.col("error_count").desc(), "service").limit(limit)


def levels_over_time(df: DataFrame, as_of: datetime, hours: int = 6, minutes: int = 5) -> DataFrame:
    rows = _recent(df, as_of, hours=hours)
    grouped = rows.groupBy(interval_bucket("timestamp", minutes).alias("w"), "level").agg(
        F.count(F.lit(1)).alias("count")
    )
    return grouped.select(F.col("w.start").alias("time_bucket"), "level", "count").orderBy(
        F.col("time_bucket").desc(), "level"
    )


def slow_requests(
    df: DataFrame, as_of: datetime, threshold: float = 1000, hours: int = 1, limit: int = 100
) -> DataFrame:
    rows = _recent(df, as_of, hours=hours).select(
        "timestamp", "service", "trace_id", "message", attr_double("response_time").alias("response_time_ms"), "id"
    )
    slow = rows.filter(F.col("response_time_ms") > threshold)
    return slow.orderBy(F.col("response_time_ms").desc(), "id").limit(limit).drop("id")


def logs_of_trace(df: DataFrame, trace_id: str) -> DataFrame:
    rows = df.filter(F.col("trace_id") == trace_id)
    return rows.select("timestamp", "level", "service", "message", "span_id", "attributes").orderBy("timestamp")


def top_error_sources(df: DataFrame, as_of: datetime, hours: int = 24, top_n: int = 10) -> DataFrame:
    rows = _recent(df.filter(F.col("level") == "error"), as_of, hours=hours)
    grouped = rows.groupBy("service").agg(
        F.count(F.lit(1)).alias("error_count"),
        F.count_distinct("trace_id").alias("affected_requests"),
        F.min("timestamp").alias("first_error"),
        F.max("timestamp").alias("last_error"),
    )
    return grouped.orderBy(F.col("error_count").desc(), "service").limit(top_n)


def level_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("level").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "level")


def service_levels(df: DataFrame, as_of: datetime, level: str, hours: int = 24, limit: int = 5) -> DataFrame:
    rows = _recent(df.filter(F.col("level") == level), as_of, hours=hours)
    grouped = rows.groupBy("service", "level").agg(F.count(F.lit(1)).alias("count"))
    return grouped.orderBy(F.col("count").desc(), "service").limit(limit)


def full_text_search(df: DataFrame, as_of: datetime, term: str, days: int = 1, limit: int = 10) -> DataFrame:
    rows = _recent(df, as_of, days=days).filter(contains_ignore_case("message", term))
    newest = rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)
    return newest.select("timestamp", "level", "service", "message")


def _metrics_of(df: DataFrame, service: str, kind: str) -> DataFrame:
    return df.filter((F.col("service") == service) & (attr("metric_type") == kind))


def healthy_checks(df: DataFrame, as_of: datetime, service: str, minutes: int = 5) -> DataFrame:
    checks = _recent(_metrics_of(df, service, "health_check"), as_of, minutes=minutes)
    return checks.filter(attr("health_status") == "UP").agg(F.count(F.lit(1)).alias("healthy_checks"))


def memory_usage(df: DataFrame, as_of: datetime, service: str, hours: int = 1) -> DataFrame:
    rows = _recent(_metrics_of(df, service, "system"), as_of, hours=hours).select(
        start_of_minute("timestamp").alias("time"), attr_double("memory_usage_percent").alias("v")
    )
    return rows.groupBy("time").agg(F.avg("v").alias("memory_percent")).orderBy("time")


def request_count(df: DataFrame, as_of: datetime, service: str, hours: int = 1) -> DataFrame:
    rows = _recent(_metrics_of(df, service, "performance"), as_of, hours=hours)
    return rows.select(attr_long("request_count").alias("v")).agg(F.max("v").alias("total_requests"))


def error_rate(df: DataFrame, as_of: datetime, service: str, hours: int = 1) -> DataFrame:
    rows = _recent(_metrics_of(df, service, "performance"), as_of, hours=hours)
    return rows.select((attr_double("error_rate") * 100).alias("v")).agg(F.avg("v").alias("avg_error_rate"))


def average_response_time(df: DataFrame, as_of: datetime, service: str, hours: int = 1) -> DataFrame:
    rows = _recent(_metrics_of(df, service, "performance"), as_of, hours=hours)
    return rows.select(attr_double("avg_response_time_ms").alias("v")).agg(F.avg("v").alias("avg_response_ms"))


def hourly_performance(df: DataFrame, service: str) -> DataFrame:
    rows = _metrics_of(df, service, "performance").select(
        start_of_hour("timestamp").alias("hour"), attr_double("avg_response_time_ms").alias("v")
    )
    grouped = rows.groupBy("hour").agg(
        F.avg("v").alias("avg_response_time"), F.count(F.lit(1)).alias("request_count")
    )
    return grouped.orderBy(F.col("hour").desc())


def phrase_timeline(df: DataFrame, as_of: datetime, service: str, phrase: str, hours: int = 2) -> DataFrame:
    rows = _recent(df.filter(F.col("service") == service), as_of, hours=hours)
    rows = rows.filter(F.col("message").like(f"%{phrase}%"))
    grouped = rows.groupBy(start_of_minute("timestamp").alias("time")).agg(F.count(F.lit(1)).alias("log_count"))
    return grouped.orderBy("time")


def error_patterns(
    df: DataFrame, as_of: datetime, service: str, levels: tuple[str, ...] = ("ERROR", "WARN"), hours: int = 24
) -> DataFrame:
    """Rows per level and exception attribute. Levels are compared as given."""
    rows = _recent(df.filter(F.col("service") == service), as_of, hours=hours)
    rows = rows.filter(F.col("level").isin(*levels)).select("level", attr("exception").alias("exception_type"))
    grouped = rows.groupBy("level", "exception_type").agg(F.count(F.lit(1)).alias("error_count"))
    return grouped.orderBy(F.col("error_count").desc(), "level", "exception_type")


def service_level_minutes(df: DataFrame, as_of: datetime, hours: int = 1) -> DataFrame:
    rows = _recent(df, as_of, hours=hours).filter(F.col("timestamp") > before(as_of, hours=hours)).select(
        "service", "level", start_of_minute("timestamp").alias("minute"), attr_double("duration_ms").alias("v")
    )
    grouped = rows.groupBy("service", "level", "minute").agg(
        F.count(F.lit(1)).alias("count"), F.avg("v").alias("avg_duration")
    )
    return grouped.orderBy(F.col("minute").desc(), F.col("count").desc(), "service", "level")


def recent_errors(
    df: DataFrame,
    as_of: datetime,
    service: str,
    levels: tuple[str, ...] = ("ERROR", "WARN"),
    hours: int = 6,
    limit: int = 50,
) -> DataFrame:
    rows = _recent(df.filter(F.col("service") == service), as_of, hours=hours).filter(F.col("level").isin(*levels))
    newest = rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)
    return newest.select(
        "timestamp",
        "level",
        "message",
        attr("exception").alias("exception"),
        attr("exception_message").alias("error_message"),
    )


def latest_system_metrics(df: DataFrame, service: str, limit: int = 10) -> DataFrame:
    newest = _metrics_of(df, service, "system").orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)
    return newest.select(
        "timestamp",
        attr("max_memory_bytes").alias("max_memory_mb"),
        attr("used_memory_bytes").alias("used_memory_mb"),
        attr("memory_usage_percent").alias("memory_percent"),
        attr("available_processors").alias("cpu_cores"),
    )


def high_memory_periods(df: DataFrame, service: str, percent: float = 80) -> DataFrame:
    rows = df.filter(F.col("service") == service).select(
        "timestamp", attr("memory_usage_percent").alias("memory_pct"), attr_double("memory_usage_percent").alias("v")
    )
    return rows.filter(F.col("v") > percent).drop("v").orderBy(F.col("timestamp").desc())


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """Bounded tail: the newest ``n`` rows."""
    return df.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def counts_by_timestamp(df: DataFrame, as_of: datetime, hours: int = 1) -> DataFrame:
    rows = _recent(df, as_of, hours=hours)
    return rows.groupBy("timestamp").agg(F.count(F.lit(1)).alias("count"))
