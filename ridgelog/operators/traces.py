"""Trace correlation: ids, spans, summaries, the span tree and timelines.

Every grouping starts after rows without a trace id are dropped, so untraced
logs never meet in one task. Groups are reduced by partial aggregates before
the shuffle; nothing collects the rows of a trace.
"""

import operator
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelog.functions.patterns import OPERATION_PATTERNS, TRACE_CONVENTIONS, TRACE_NEEDLES, re2
from ridgelog.functions.scalars import _col, apart, attr, epoch_micros, epoch_millis, first_words, has_attr, ntz, with_computed
from ridgelog.session import checkpointed

IDLE_SECONDS = 3600


def trace_id(log_trace="trace_id", attributes="attributes", message="message") -> Column:
    """The log's trace id, else an attribute, else the first message convention."""
    found = [F.nullif(_col(log_trace), F.lit(""))]
    for name in dict.fromkeys(c[0] for c in TRACE_CONVENTIONS):
        found.append(F.nullif(attr(name, attributes), F.lit("")))
    text = _col(message)
    in_text = [F.nullif(F.regexp_extract(text, re2(p), 1), F.lit("")) for *_, p in TRACE_CONVENTIONS]
    possible = reduce(operator.or_, [text.contains(n) for n in TRACE_NEEDLES])
    return F.coalesce(*found, F.when(possible, F.coalesce(*in_text)), F.lit(""))


def _last_convention(position: int, attributes) -> list[Column]:
    """Attribute values by falling precedence: the last convention wins."""
    names = dict.fromkeys(c[position] for c in reversed(TRACE_CONVENTIONS))
    return [F.nullif(attr(n, attributes), F.lit("")) for n in names]


def span_id(log_span="span_id", attributes="attributes") -> Column:
    """Span id of the last convention present in the attributes, else the log's own."""
    return F.coalesce(*_last_convention(1, attributes), _col(log_span), F.lit(""))


def parent_id(attributes="attributes") -> Column:
    return F.coalesce(*_last_convention(2, attributes), F.lit(""))


def with_trace_ids(df: DataFrame) -> DataFrame:
    """Set trace_id, span_id and parent_id. A log outside of any trace keeps its span id."""
    df = with_computed(df, "_trace", trace_id())
    traced = F.col("_trace") != ""
    return df.withColumns(
        {
            "parent_id": F.when(traced, parent_id()).otherwise(F.lit("")),
            "span_id": F.when(traced, span_id()).otherwise(F.col("span_id")),
            "trace_id": F.col("_trace"),
        }
    ).drop("_trace")


def operation_name(message="message", attributes="attributes") -> Column:
    """Attribute ``operation`` or ``span.name``, a known phrase, the first words, or unknown."""
    text = _col(message)
    name = F.when(has_attr("operation", attributes), _col(attributes)["operation"])
    name = name.when(has_attr("span.name", attributes), _col(attributes)["span.name"])
    for source, group in OPERATION_PATTERNS:
        pattern = re2(source, True)
        name = name.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
    return name.otherwise(F.coalesce(F.nullif(first_words(text, 3), F.lit("")), F.lit("unknown")))


def span_status(level="level") -> Column:
    word = F.lower(_col(level))
    return (
        F.when(word.isin("error", "fatal", "panic"), F.lit("error"))
        .when(word.isin("warn", "warning"), F.lit("warning"))
        .otherwise(F.lit("ok"))
    )


def _failed(level="level") -> Column:
    return F.lower(_col(level)).isin("error", "fatal")


def _duration_ms(start: str, end: str) -> Column:
    return F.floor((epoch_micros(end) - epoch_micros(start)) / 1000)


def _traced(df: DataFrame) -> DataFrame:
    """Only what trace aggregates read, rows with a trace id only."""
    return with_trace_ids(df).filter(F.col("trace_id") != "")


def _head() -> Column:
    """What a span takes from its first log, led by the sort key (timestamp, id)."""
    return F.struct(
        "timestamp",
        "id",
        "service",
        "parent_id",
        apart(operation_name()).alias("operation"),
        span_status().alias("status"),
    )


def span_parts(df: DataFrame) -> DataFrame:
    """Traced logs reduced to (trace, span, service); logs without a span keep span ''.

    The reduction combines on the map side, so a hot trace leaves a task as its
    distinct spans and services, never as its logs. Both summaries follow from
    these rows; columns a summary does not use are pruned.
    """
    rows = _traced(df).select(
        "trace_id", "span_id", "service", "timestamp", _failed().cast("bigint").alias("failed"), _head().alias("head")
    )
    return rows.groupBy("trace_id", "span_id", "service").agg(
        F.min("head").alias("head"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
        F.sum("failed").alias("errors"),
        F.count(F.lit(1)).alias("logs"),
    )


def traces_of(parts: DataFrame) -> DataFrame:
    """One row per trace from ``span_parts``. The service set grows with the services only."""
    return (
        parts.groupBy("trace_id")
        .agg(
            F.min("first").alias("start_time"),
            F.max("last").alias("end_time"),
            F.count_distinct(F.nullif("span_id", F.lit(""))).alias("span_count"),
            F.sum("errors").alias("error_count"),
            F.sum("logs").alias("log_count"),
            F.sort_array(F.collect_set(F.nullif("service", F.lit("")))).alias("services"),
        )
        .withColumn("service_count", F.size("services").cast("bigint"))
        .withColumn("duration_ms", _duration_ms("start_time", "end_time"))
    )


def trace_summary(df: DataFrame) -> DataFrame:
    """One row per trace: bounds, duration, services, spans and errors."""
    return traces_of(span_parts(df))


def trace_services(df: DataFrame) -> DataFrame:
    """Distinct (trace, service) pairs."""
    return _traced(df).filter(F.col("service") != "").select("trace_id", "service").distinct()


def _span_columns(spans: DataFrame) -> DataFrame:
    return spans.select(
        "trace_id",
        "span_id",
        F.col("head.parent_id").alias("parent_id"),
        F.col("head.service").alias("service"),
        F.col("head.operation").alias("operation"),
        F.when(F.col("errors") > 0, F.lit("error")).otherwise(F.col("head.status")).alias("status"),
        "start_time",
        "end_time",
        _duration_ms("start_time", "end_time").alias("duration_ms"),
        "log_count",
        F.col("head.id").alias("first_log_id"),
    )


def spans_of(parts: DataFrame) -> DataFrame:
    """One row per span from ``span_parts``."""
    spans = parts.filter(F.col("span_id") != "").groupBy("trace_id", "span_id")
    return _span_columns(
        spans.agg(
            F.min("head").alias("head"),
            F.min("first").alias("start_time"),
            F.max("last").alias("end_time"),
            F.sum("errors").alias("errors"),
            F.sum("logs").alias("log_count"),
        )
    )


def span_summary(df: DataFrame) -> DataFrame:
    """One row per span, in one reduction. 'First' is the earliest log by (timestamp, id)."""
    rows = _traced(df).filter(F.col("span_id") != "")
    rows = rows.select(
        "trace_id", "span_id", "timestamp", _failed().cast("bigint").alias("failed"), _head().alias("head")
    )
    return _span_columns(
        rows.groupBy("trace_id", "span_id").agg(
            F.min("head").alias("head"),
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            F.sum("failed").alias("errors"),
            F.count(F.lit(1)).alias("log_count"),
        )
    )


def root_spans(spans: DataFrame) -> DataFrame:
    """The first span without a parent, per trace."""
    first = F.min(F.struct("start_time", "first_log_id", "span_id", "service", "operation"))
    return (
        spans.filter(F.col("parent_id") == "")
        .groupBy("trace_id")
        .agg(first.alias("root"))
        .select(
            "trace_id",
            F.col("root.span_id").alias("root_span_id"),
            F.col("root.service").alias("root_service"),
            F.col("root.operation").alias("root_operation"),
        )
    )


def span_tree(spans: DataFrame) -> DataFrame:
    """Child to parent edges inside a trace: an equi-join of the spans with themselves.

    One row per child whose parent exists. Edges rather than nested lists, so a
    parent with very many children stays spread over tasks (AQE splits the
    skewed side). Both sides read ``spans``: pass a stored table, or the result
    of ``session.checkpointed``, so the logs are not reduced twice.
    """
    child = spans.filter(F.col("parent_id") != "").select(
        "trace_id", F.col("parent_id"), F.col("span_id").alias("child_id"), F.col("service").alias("child_service")
    )
    parent = spans.select(
        "trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("parent_service")
    )
    return child.join(parent, ["trace_id", "parent_id"])


def child_counts(spans: DataFrame) -> DataFrame:
    """Number of children of every span that has some."""
    return span_tree(spans).groupBy("trace_id", "parent_id").agg(F.count(F.lit(1)).alias("children"))


def timeline(df: DataFrame) -> DataFrame:
    """One event per span with epoch-millisecond bounds, next to the trace's own bounds.

    The logs are read once: spans and traces both come from the stored parts.
    """
    parts = checkpointed(span_parts(df), "span-parts")
    events = spans_of(parts).select(
        "trace_id",
        "span_id",
        "parent_id",
        "service",
        "operation",
        epoch_millis("start_time").alias("start"),
        epoch_millis("end_time").alias("end"),
        F.col("duration_ms").alias("duration"),
        "status",
        F.col("log_count").alias("logs"),
    )
    traces = traces_of(parts).select(
        "trace_id",
        epoch_millis("start_time").alias("trace_start"),
        epoch_millis("end_time").alias("trace_end"),
        "service_count",
        "span_count",
        "error_count",
    )
    return events.join(traces, "trace_id")


def list_traces(traces: DataFrame, limit: int = 100) -> DataFrame:
    """The newest traces."""
    return traces.orderBy(F.col("start_time").desc(), F.col("trace_id").desc()).limit(limit)


def search_traces(traces: DataFrame, term: str) -> DataFrame:
    """Traces whose id or one of whose services contains the term, ignoring case."""
    wanted = term.lower()
    in_service = F.exists("services", lambda s: F.lower(s).contains(wanted))
    return traces.filter(F.lower("trace_id").contains(wanted) | in_service)


def error_spans(spans: DataFrame) -> DataFrame:
    """Number of failed spans per trace, 0 included."""
    return spans.groupBy("trace_id").agg(F.count_if(F.col("status") == "error").alias("error_spans"))


def trace_sessions(df: DataFrame, gap_seconds: int = IDLE_SECONDS, cell_seconds: int = 60) -> DataFrame:
    """Trace activity closed after an idle gap.

    Logs are first reduced to one row per trace and time cell. A cell is shorter
    than the gap, so it never spans two sessions, and the ordered window sees at
    most one row per cell: a hot trace is bounded by the time span.
    """
    rows = _traced(df).select("trace_id", "timestamp", _failed().cast("bigint").alias("failed"))
    cell = F.floor(epoch_micros("timestamp") / (cell_seconds * 1_000_000))
    cells = rows.groupBy("trace_id", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("logs"),
        F.sum("failed").alias("errors"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )
    by_time = Window.partitionBy("trace_id").orderBy("cell")
    idle = epoch_micros("first") - epoch_micros(F.lag("last").over(by_time))
    opens = F.when(idle <= gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = cells.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(by_time))
    return numbered.groupBy("trace_id", "session").agg(
        F.min("first").alias("first_log"),
        F.max("last").alias("last_log"),
        F.sum("logs").alias("log_count"),
        F.sum("errors").alias("error_count"),
    ).drop("session")


def closed_sessions(sessions: DataFrame, as_of: datetime, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions that have been idle for longer than the gap at ``as_of``."""
    return sessions.filter(F.col("last_log") < ntz(as_of - timedelta(seconds=gap_seconds)))
