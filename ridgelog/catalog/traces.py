"""Trace correlation."""

from pyspark.sql import functions as F

from ridgelog.catalog.registry import query
from ridgelog.catalog.tables import AS_OF, LOGS, document_logs, event_logs
from ridgelog.functions.patterns import OPERATION_PATTERNS, TRACE_CONVENTIONS
from ridgelog.operators import traces as t
from ridgelog.operators.spantree import span_depths as depths_of
from ridgelog.session import checkpointed

_IN_TEXT = ", ".join(f"nullif(regexp_extract(message, '{pattern}', 1), '')" for *_, pattern in TRACE_CONVENTIONS)
_TRACE = f"CASE WHEN trace_id <> '' THEN trace_id WHEN a_traceID <> '' THEN a_traceID ELSE coalesce({_IN_TEXT}, '') END"
_NAMED = " ".join(
    f"WHEN regexp_matches(message, '(?i){pattern}') THEN regexp_extract(message, '(?i){pattern}', {group})" for pattern, group in OPERATION_PATTERNS
)
_OPERATION = rf"""CASE WHEN a_operation <> '' THEN a_operation WHEN a_span_name <> '' THEN a_span_name {_NAMED}
 WHEN trim(message) = '' THEN 'unknown' ELSE array_to_string(string_split_regex(trim(message), '\s+')[1:3], ' ') END"""
_STATUS = "CASE WHEN lower(level) IN ('error', 'fatal', 'panic') THEN 'error' WHEN lower(level) IN ('warn', 'warning') THEN 'warning' ELSE 'ok' END"

_TRACED = f"""{LOGS}, ids AS (SELECT id, timestamp, level, service, message, {_TRACE} AS trace_id, span_id, a_parent_span_id AS parent,
 {_OPERATION} AS operation, {_STATUS} AS status, lower(level) IN ('error', 'fatal') AS failed FROM logs),
 traced AS (SELECT * FROM ids WHERE trace_id <> '')"""
_SPANS = f"""{_TRACED}, spans AS (SELECT trace_id, span_id, arg_min(parent, (timestamp, id)) AS parent_id, arg_min(service, (timestamp, id)) AS service,
 arg_min(operation, (timestamp, id)) AS operation, CASE WHEN bool_or(failed) THEN 'error' ELSE arg_min(status, (timestamp, id)) END AS status,
 min(timestamp) AS start_time, max(timestamp) AS end_time, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000 AS duration_ms,
 count(*) AS log_count, arg_min(id, (timestamp, id)) AS first_log_id FROM traced WHERE span_id <> '' GROUP BY trace_id, span_id)"""
_SUMMARY = """summary AS (SELECT trace_id, min(timestamp) AS start_time, max(timestamp) AS end_time,
 count(DISTINCT NULLIF(span_id, '')) AS span_count, count(*) FILTER (failed) AS error_count, count(*) AS log_count,
 coalesce(string_agg(DISTINCT NULLIF(service, ''), ',' ORDER BY NULLIF(service, '')), '') AS services,
 count(DISTINCT NULLIF(service, '')) AS service_count,
 (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000 AS duration_ms FROM traced GROUP BY trace_id)"""


def _spans(spark, sf_dir):
    return t.span_summary(event_logs(spark, sf_dir))


@query("trace_ids", f"WITH {_TRACED} SELECT id, trace_id, span_id, CASE WHEN trace_id <> '' THEN parent ELSE '' END AS parent_id FROM ids")
def trace_ids(spark, sf_dir):
    return t.with_trace_ids(event_logs(spark, sf_dir)).select("id", "trace_id", "span_id", "parent_id")


@query(
    "trace_ids_documents",
    r"""SELECT 'doc-' || doc_id AS id, coalesce(nullif(regexp_extract(text, 'trace[_-]?id["\s:=]+([a-fA-F0-9]{32})', 1), ''),
 nullif(regexp_extract(text, '"?traceID"?\s*:\s*"?([a-fA-F0-9]{32})"?', 1), ''),
 nullif(regexp_extract(text, '"?traceId"?\s*:\s*"?([a-fA-F0-9]{16,32})"?', 1), ''),
 nullif(regexp_extract(text, 'Root=([0-9a-fA-F-]+);', 1), ''), '') AS trace_id FROM documents""",
)
def trace_ids_documents(spark, sf_dir):
    return document_logs(spark, sf_dir).select("id", t.trace_id().alias("trace_id"))


@query("span_operations", f"WITH {_TRACED} SELECT id, operation, status FROM ids")
def span_operations(spark, sf_dir):
    return event_logs(spark, sf_dir).select("id", t.operation_name().alias("operation"), t.span_status().alias("status"))


@query("trace_summary", f"WITH {_TRACED}, {_SUMMARY} SELECT * FROM summary")
def trace_summary(spark, sf_dir):
    return t.trace_summary(event_logs(spark, sf_dir)).withColumn("services", F.array_join("services", ","))


@query("trace_services", f"WITH {_TRACED} SELECT DISTINCT trace_id, service FROM traced WHERE service <> ''")
def trace_services(spark, sf_dir):
    return t.trace_services(event_logs(spark, sf_dir))


@query("span_summary", f"WITH {_SPANS} SELECT * FROM spans")
def span_summary(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(
    "root_spans",
    f"""WITH {_SPANS} SELECT trace_id, arg_min(span_id, (start_time, first_log_id)) AS root_span_id,
 arg_min(service, (start_time, first_log_id)) AS root_service, arg_min(operation, (start_time, first_log_id)) AS root_operation
 FROM spans WHERE parent_id = '' GROUP BY trace_id""",
)
def root_spans(spark, sf_dir):
    return t.root_spans(_spans(spark, sf_dir))


@query(
    "span_tree",
    f"""WITH {_SPANS} SELECT c.trace_id, c.parent_id, c.span_id AS child_id, c.service AS child_service, p.service AS parent_service
 FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id""",
)
def span_tree(spark, sf_dir):
    return t.span_tree(checkpointed(_spans(spark, sf_dir), "spans"))


@query(
    "child_counts",
    f"""WITH {_SPANS} SELECT c.trace_id, c.parent_id, count(*) AS children FROM spans c JOIN spans p ON c.trace_id = p.trace_id
 AND c.parent_id = p.span_id GROUP BY 1, 2""",
)
def child_counts(spark, sf_dir):
    return t.child_counts(checkpointed(_spans(spark, sf_dir), "spans"))


@query(
    "span_depths",
    f"""WITH RECURSIVE {_SPANS}, down AS (SELECT trace_id, span_id, 0 AS depth, span_id AS root FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_id)
 UNION ALL SELECT s.trace_id, s.span_id, depth + 1, root FROM down JOIN spans s ON s.trace_id = down.trace_id AND s.parent_id = down.span_id),
 above AS (SELECT trace_id, span_id, span_id AS top FROM spans UNION ALL SELECT a.trace_id, a.span_id, p.span_id FROM above a JOIN spans s ON s.trace_id = a.trace_id AND s.span_id = a.top
 JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id), sizes AS (SELECT trace_id, top AS span_id, count(*) AS subtree_size FROM above GROUP BY 1, 2)
 SELECT trace_id, span_id, CAST(depth AS BIGINT) AS depth, root AS root_span_id, subtree_size, false AS in_cycle FROM down JOIN sizes USING (trace_id, span_id)""",
)
def span_depths(spark, sf_dir):
    return depths_of(checkpointed(_spans(spark, sf_dir), "spans"))


@query(
    "trace_timeline",
    f"""WITH {_SPANS}, {_SUMMARY} SELECT s.trace_id, span_id, parent_id, service, operation, epoch_us(s.start_time) // 1000 AS start, epoch_us(s.end_time) // 1000 AS "end",
 s.duration_ms AS duration, status, s.log_count AS logs, epoch_us(m.start_time) // 1000 AS trace_start, epoch_us(m.end_time) // 1000 AS trace_end,
 m.service_count, m.span_count, m.error_count FROM spans s JOIN summary m USING (trace_id)""",
)
def trace_timeline(spark, sf_dir):
    return t.timeline(event_logs(spark, sf_dir))


@query("list_traces", f"WITH {_TRACED}, {_SUMMARY} SELECT trace_id, start_time, log_count FROM summary ORDER BY start_time DESC, trace_id DESC LIMIT 100")
def list_traces(spark, sf_dir):
    return t.list_traces(t.trace_summary(event_logs(spark, sf_dir))).select("trace_id", "start_time", "log_count")


@query(
    "search_traces",
    f"""WITH {_TRACED}, {_SUMMARY} SELECT trace_id, services FROM summary WHERE contains(lower(trace_id), 'cache') OR contains(services, 'cache')""",
)
def search_traces(spark, sf_dir):
    found = t.search_traces(t.trace_summary(event_logs(spark, sf_dir)), "CACHE")
    return found.select("trace_id", F.array_join("services", ",").alias("services"))


@query("error_spans", f"WITH {_SPANS} SELECT trace_id, count(*) FILTER (status = 'error') AS error_spans FROM spans GROUP BY trace_id")
def error_spans(spark, sf_dir):
    return t.error_spans(_spans(spark, sf_dir))


_SESSIONS = f"""{_TRACED}, gaps AS (SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM traced
 WINDOW w AS (PARTITION BY trace_id ORDER BY timestamp)), numbered AS (SELECT *, sum(opens) OVER (PARTITION BY trace_id ORDER BY timestamp) AS no FROM gaps),
 sessions AS (SELECT trace_id, min(timestamp) AS first_log, max(timestamp) AS last_log, count(*) AS log_count, count(*) FILTER (failed) AS error_count
 FROM numbered GROUP BY trace_id, no)"""


@query("trace_sessions", f"WITH {_SESSIONS} SELECT * FROM sessions")
def trace_sessions(spark, sf_dir):
    return t.trace_sessions(event_logs(spark, sf_dir))


@query("idle_traces", f"WITH {_SESSIONS} SELECT * FROM sessions WHERE last_log < TIMESTAMP '2024-01-30 23:00:00'")
def idle_traces(spark, sf_dir):
    return t.closed_sessions(t.trace_sessions(event_logs(spark, sf_dir)), AS_OF)
