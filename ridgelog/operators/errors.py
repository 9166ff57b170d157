"""Error detection: tags, statistics, rates, trends and anomalies."""

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelog.functions.patterns import ERROR_LEVELS, ERROR_PATTERNS, re2
from ridgelog.functions.scalars import attr, attr_double, compact_texts, ntz, seconds_between

HIGH_RATE = 10.0
DEVIATIONS = 2.0
HISTORY = 100
MIN_HISTORY = 10
TREND_WINDOW = timedelta(minutes=5)
STATS_TTL = timedelta(hours=24)
MAX_SAMPLES = 10


@dataclass(frozen=True)
class _Indication:
    """One way a log shows an error: when, and how it is tagged and counted."""

    when: Column
    tag: Column
    category: Column
    pattern: Column


def _with_folded(df: DataFrame) -> DataFrame:
    """Add the message with every character that matches an ASCII letter folded onto it."""
    return df.withColumn("_folded", F.lower(F.upper("message")))


def _indications() -> list[_Indication]:
    """Level, message patterns, error attribute, HTTP status; needs ``_with_folded``.

    The substring search on the folded message decides most patterns; only the
    remaining messages meet the regular expression.
    """
    level, code = F.col("level"), attr_double("status_code").try_cast("int")
    # a code beyond the integers, or no number at all, is no status
    status, code = code, code.cast("string")
    is_error_level = F.lower(level).isin(list(ERROR_LEVELS))
    found = [_Indication(is_error_level, F.concat(F.lit("level:"), level), level, F.lit("LogLevel"))]
    for name, category, pattern, needles in ERROR_PATTERNS:
        possible = reduce(operator.or_, [F.col("_folded").contains(n) for n in needles])
        matched = possible & F.col("message").rlike(re2(pattern))
        found.append(_Indication(matched, F.lit(f"{category}:{name}"), F.lit(category), F.lit(name)))
    found.append(
        _Indication(attr("error") != "", F.lit("attribute:error"), F.lit("attribute"), F.lit("AttributeError"))
    )
    family = F.when(status >= 500, F.lit("http5xx")).otherwise(F.lit("http4xx"))
    found.append(
        _Indication(status >= 400, F.concat(F.lit("http:"), code), family, F.concat(F.lit("HTTP"), code))
    )
    return found


def with_detected_errors(df: DataFrame) -> DataFrame:
    """Attach the error tags to every log."""
    tags = compact_texts([F.when(i.when, i.tag) for i in _indications()])
    return _with_folded(df).withColumn("detected_errors", tags).drop("_folded")


def with_hits(df: DataFrame, *columns: str) -> DataFrame:
    """One row per log and error indication: the given columns, category and pattern."""
    hits = compact_texts([F.when(i.when, F.concat(i.category, F.lit("\x02"), i.pattern)) for i in _indications()])
    rows = _with_folded(df).select(*columns, F.explode(hits).alias("hit"))
    parts = F.split("hit", "\x02")
    return rows.select(*columns, parts[0].alias("category"), parts[1].alias("pattern"))


def failing_logs(df: DataFrame) -> DataFrame:
    """Logs with at least one error indication."""
    columns = df.columns
    failing = reduce(operator.or_, [F.coalesce(i.when, F.lit(False)) for i in _indications()])
    return _with_folded(df).filter(failing).select(*columns)


def error_counts(df: DataFrame) -> DataFrame:
    """Occurrences per category, pattern and service, with first and last time."""
    return (
        with_hits(df, "timestamp", "service")
        .groupBy("category", "pattern", "service")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )


def error_statistics(counts: DataFrame, as_of: datetime) -> DataFrame:
    """Statistics per category and pattern from the counts per service.

    ``rate`` is per minute at the last occurrence, ``current_rate`` per minute at
    ``as_of``; their ratio gives the trend. Quiet for longer than the trend
    window means stable.
    """
    stats = counts.groupBy("category", "pattern").agg(
        F.sum("count").alias("count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("service", "count")))).alias("services"),
    )
    return rated(stats, ntz(as_of))


def rated(stats: DataFrame, now: Column) -> DataFrame:
    """Rate, current rate and trend of statistics at the time ``now``."""
    active = seconds_between("first_seen", "last_seen") / 60
    alive = seconds_between(F.col("first_seen"), now) / 60
    stats = stats.withColumns(
        {
            "rate": F.when(active > 0, F.col("count") / active).otherwise(F.lit(0.0)),
            "current_rate": F.when(alive > 0, F.col("count") / alive).otherwise(F.lit(0.0)),
        }
    )
    quiet = F.col("last_seen") < now - F.expr(f"INTERVAL '{int(TREND_WINDOW.total_seconds())}' SECOND")
    trend = (
        F.when(quiet, F.lit("stable"))
        .when(F.col("rate") > F.col("current_rate") * 1.2, F.lit("increasing"))
        .when(F.col("rate") < F.col("current_rate") * 0.8, F.lit("decreasing"))
        .otherwise(F.lit("stable"))
    )
    return stats.withColumn("trend", trend)


def error_samples(df: DataFrame, limit: int = MAX_SAMPLES) -> DataFrame:
    """The first ``limit`` logs per category and pattern, one row each.

    The rank filter is applied per task before the shuffle (window group limit),
    so a hot pattern sends at most ``limit`` rows per task.
    """
    w = Window.partitionBy("category", "pattern").orderBy("timestamp", "id")
    hits = with_hits(df, "id", "timestamp", "service", "message", "trace_id")
    ranked = hits.withColumn("sample", F.row_number().over(w))
    return ranked.filter(F.col("sample") <= limit).select(
        "category", "pattern", "sample", F.col("id").alias("log_id"), "timestamp", "service", "message", "trace_id"
    )


def trends_by_category(stats: DataFrame) -> DataFrame:
    return stats.groupBy("category").agg(
        F.sum("count").alias("total_errors"),
        F.avg("rate").alias("avg_rate"),
        F.count(F.lit(1)).alias("patterns"),
        F.count_if(F.col("trend") == "increasing").alias("increasing"),
        F.count_if(F.col("trend") == "decreasing").alias("decreasing"),
    )


def high_rate_alerts(stats: DataFrame, threshold: float = HIGH_RATE) -> DataFrame:
    """Patterns whose rate exceeds the threshold."""
    return stats.filter(F.col("rate") > threshold).select(
        F.lit("high_error_rate").alias("type"),
        F.concat_ws(":", "category", "pattern").alias("pattern"),
        "category",
        F.col("rate").alias("current_rate"),
        F.lit(threshold).alias("threshold"),
        F.lit("warning").alias("severity"),
        F.format_string(f"Error rate %.2f/min exceeds threshold {threshold:.2f}/min", "rate").alias("message"),
    )


def errors_per_minute(df: DataFrame) -> DataFrame:
    """Logs with at least one error indication, per service and minute."""
    return (
        failing_logs(df)
        .groupBy("service", F.window("timestamp", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("errors"))
        .select("service", F.col("w.start").alias("minute"), "errors")
    )


def with_z_score(
    series: DataFrame,
    value: str,
    keys: Sequence[str],
    order: str,
    history: int = HISTORY,
    min_history: int = MIN_HISTORY,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """Score each point against the last ``history`` points, the point included.

    The spread is the sample standard deviation (the square root of the
    variance, as intended by the detector this follows). Input is a series at
    most one row per key and time step, so a partition is bounded by the time
    span, not by the number of logs.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(history - 1), 0)
    scored = series.withColumns(
        {
            "points": F.count(value).over(w),
            "mean": F.avg(value).over(w),
            "std_dev": F.stddev_samp(value).over(w),
        }
    )
    known = (F.col("points") >= min_history) & (F.col("std_dev") > 0)
    z = (F.col(value) - F.col("mean")) / F.col("std_dev")
    return scored.withColumn("z_score", F.when(known, z)).withColumn(
        "is_anomaly", F.coalesce(F.abs("z_score") > deviations, F.lit(False))
    )


def anomalies(df: DataFrame) -> DataFrame:
    """Minutes whose error count is out of line with the history of the service."""
    return with_z_score(errors_per_minute(df), "errors", ["service"], "minute").filter("is_anomaly")


def live_statistics(stats: DataFrame, as_of: datetime, ttl: timedelta = STATS_TTL) -> DataFrame:
    """Statistics hit within the time to live."""
    return stats.filter(F.col("last_seen") >= ntz(as_of - ttl))


def category_distribution(stats: DataFrame) -> DataFrame:
    """Errors per category and their share of all errors.

    The total is a one-row subquery, so no window gathers the categories.
    """
    per_category = stats.groupBy("category").agg(F.sum("count").alias("errors"))
    everything = stats.agg(F.sum("count")).scalar()
    return per_category.withColumn("share", F.col("errors") / everything)


def error_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_errors"),
        F.count(F.lit(1)).alias("patterns"),
        F.count_distinct("category").alias("categories"),
    )


def top_by_rate(stats: DataFrame, limit: int = 10) -> DataFrame:
    return stats.orderBy(F.col("rate").desc(), "category", "pattern").limit(limit)
