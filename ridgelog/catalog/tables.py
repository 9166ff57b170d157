"""Logs, raw lines and metrics derived from the given tables.

The derivation is one projection of ``events`` (or ``documents``), written once
as SQL expressions that Spark and the checking engine both understand. Logs and
text lines are ingested into a stored table below the shared folder, once per
application; every query then reads the whole table.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgelog.functions.scalars import apart
from ridgelog.schema import LOG_FIELDS
from ridgelog.session import scratch_path
from ridgelog.storage.table import write_logs
from ridgelog.streaming.jobs import stream_files

#: the reference time of all queries: the end of the events
AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
#: a range in hours that covers all events
ALL_HOURS = 24 * 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_SERVICE = """CASE WHEN k = 50 THEN '' WHEN k = 51 THEN 'legacy service'
 WHEN user_id % 8 = 0 THEN 'api-gateway' WHEN user_id % 8 = 1 THEN 'user-service'
 WHEN user_id % 8 = 2 THEN 'order-service' WHEN user_id % 8 = 3 THEN 'payment-service'
 WHEN user_id % 8 = 4 THEN 'cache-service' WHEN user_id % 8 = 5 THEN 'auth-service'
 WHEN user_id % 8 = 6 THEN 'spring-boot-app' ELSE 'analytics-service' END"""
_LEVEL = """CASE WHEN user_id % 8 = 6 AND event_type = 'error' THEN 'ERROR'
 WHEN user_id % 8 = 6 AND event_type = 'purchase' THEN 'WARN'
 WHEN event_type = 'error' AND k >= 90 THEN 'fatal' WHEN event_type = 'error' THEN 'error'
 WHEN event_type = 'purchase' AND k < 50 THEN 'warn' WHEN event_type = 'view' THEN 'debug' ELSE 'info' END"""
_ERROR_TEXT = """CASE k % 10
 WHEN 0 THEN 'NullPointerException: null pointer at com.example.Service.call(Service.java:45)'
 WHEN 1 THEN 'Connection refused: Unable to connect to cache at localhost:6379'
 WHEN 2 THEN 'SQL Error: Deadlock detected when trying to acquire lock'
 WHEN 3 THEN 'HTTP 503 Service Unavailable: Payment gateway timeout'
 WHEN 4 THEN 'Out of memory: Java heap space'
 WHEN 5 THEN 'Request timeout after 30000ms'
 WHEN 6 THEN 'Failed to process payment: permission denied'
 WHEN 7 THEN 'Disk full: no space left on device'
 WHEN 8 THEN 'Critical: System shutting down due to unrecoverable error'
 ELSE 'HTTP 404 Not Found for /api/items/' || CAST(k AS STRING) END"""
_AMOUNT = "CAST(CAST(value AS DECIMAL(12,2)) AS STRING)"
_TRACE = "md5('trace-' || CAST(trace_no AS STRING))"
_MESSAGE = f"""(CASE event_type
 WHEN 'error' THEN {_ERROR_TEXT}
 WHEN 'view' THEN 'GET /api/items/' || CAST(k AS STRING) || ' Request completed user_id=u' || CAST(user_id AS STRING)
   || ' in ' || {_AMOUNT} || 'ms'
 WHEN 'click' THEN '  operation: checkout request_id=req-' || CAST(event_id AS STRING) || ' user_id=u'
   || CAST(user_id AS STRING) || '  '
 WHEN 'purchase' THEN 'Rate limit approaching for u' || CAST(user_id AS STRING) || ': ' || {_AMOUNT} || ' of 500.00'
 ELSE 'calling register(' || CAST(user_id AS STRING) || ') for new account' END)
 || (CASE WHEN k % 5 = 3 THEN ' trace_id=' || {_TRACE} ELSE '' END)"""


def _span(number: str) -> str:
    return f"substr(md5('span-' || CAST({number} AS STRING)), 1, 16)"


#: columns of the derived logs
LOG_COLUMNS = {
    "id": "'ev-' || CAST(event_id AS STRING)",
    "timestamp": "ts",
    "level": _LEVEL,
    "message": _MESSAGE,
    "service": _SERVICE,
    "trace_id": f"CASE WHEN k % 5 < 2 THEN {_TRACE} ELSE '' END",
    "span_id": f"CASE WHEN k % 19 = 0 THEN '' ELSE {_span('span_no')} END",
}

_SYSTEM = "user_id % 8 = 6 AND k % 3 = 0"
_PERFORMANCE = "user_id % 8 = 6 AND k % 3 = 1"
_HEALTH = "user_id % 8 = 6 AND k % 3 = 2"
#: attributes of the derived logs; NULL means the key is missing
ATTRIBUTES = {
    "traceID": f"CASE WHEN k % 5 = 2 THEN {_TRACE} END",
    "parent_span_id": f"""CASE WHEN span_no > trace_no * 3 AND span_no % 2 = 0 THEN {_span('(span_no - 1)')}
 WHEN span_no > trace_no * 3 THEN {_span('(trace_no * 3)')} END""",
    "operation": "CASE WHEN k % 7 = 0 THEN 'db.query' END",
    "span.name": "CASE WHEN k % 7 = 1 THEN 'render' END",
    "user_id": "'u' || CAST(user_id AS STRING)",
    "app": "CASE WHEN k % 13 = 0 OR k = 50 THEN 'mapped-app' END",
    "response_time": "CASE WHEN event_type IN ('view', 'click') THEN CAST(CAST(value * 10 AS DECIMAL(12,1)) AS STRING) END",
    "status_code": """CASE WHEN event_type = 'error' AND k % 3 = 0 THEN '404' WHEN event_type = 'error' AND k % 3 = 1
 THEN '500' WHEN event_type = 'error' THEN '503' WHEN event_type = 'view' THEN '200' END""",
    "error": "CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'connection_timeout' END",
    "exception": """CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'java.lang.NullPointerException'
 WHEN event_type = 'error' THEN 'java.io.IOException' END""",
    "exception_message": "CASE WHEN event_type = 'error' THEN 'code ' || CAST(k AS STRING) END",
    "metric_type": f"CASE WHEN {_SYSTEM} THEN 'system' WHEN {_PERFORMANCE} THEN 'performance' WHEN {_HEALTH} THEN 'health_check' END",
    "health_status": f"CASE WHEN {_HEALTH} AND k % 2 = 0 THEN 'UP' WHEN {_HEALTH} THEN 'DOWN' END",
    "memory_usage_percent": f"CASE WHEN {_SYSTEM} THEN CAST(k AS STRING) || '.5' END",
    "max_memory_bytes": f"CASE WHEN {_SYSTEM} THEN '8589934592' END",
    "used_memory_bytes": f"CASE WHEN {_SYSTEM} THEN CAST(k * 1000 AS STRING) END",
    "available_processors": f"CASE WHEN {_SYSTEM} THEN '8' END",
    "request_count": f"CASE WHEN {_PERFORMANCE} THEN CAST(event_id AS STRING) END",
    "error_rate": f"CASE WHEN {_PERFORMANCE} THEN '0.' || lpad(CAST(k AS STRING), 2, '0') END",
    "avg_response_time_ms": f"CASE WHEN {_PERFORMANCE} AND k % 10 > 0 THEN {_AMOUNT} END",
    "duration_ms": f"CASE WHEN k % 11 = 0 THEN 'n/a' ELSE {_AMOUNT} END",
}


def _numbered(events: DataFrame) -> DataFrame:
    return events.selectExpr("*", f"{_K} AS k", "event_id div 6 AS trace_no", "event_id div 2 AS span_no")


def derive_logs(events: DataFrame) -> DataFrame:
    """``events`` as logs, batch or stream, in one projection."""
    pairs = ", ".join(f"'{k}', {e}" for k, e in ATTRIBUTES.items())
    columns = [f"{e} AS {c}" for c, e in LOG_COLUMNS.items()]
    return _numbered(events).select(*[F.expr(c) for c in columns], apart(F.expr(f"map({pairs})")).alias("attributes"))


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a table written once per application below the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def logs_path(spark: SparkSession, sf_dir: str) -> str:
    """The stored ``logs`` table: ``events`` as logs, ingested by the table writer.

    Timestamps are cut to milliseconds on write. Queries then see plain columns,
    as they do on a real table, and their filters reach the Parquet scan.
    """

    def write(path: str) -> None:
        write_logs(derive_logs(_landed(table(spark, sf_dir, "events"))), path)

    return _stored(spark, sf_dir, "logs", write)


STORED_SCHEMA = (
    "id string, timestamp timestamp_ntz, level string, message string, service string, trace_id string, span_id string, "
    "attributes map<string,string>, hour_partition int, level_numeric int, date_partition date"
)


def stored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(STORED_SCHEMA).parquet(logs_path(spark, sf_dir))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_logs(spark, sf_dir).drop("hour_partition", "level_numeric")


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the stored table as a stream."""
    stream = stream_files(spark, logs_path(spark, sf_dir), StructType.fromDDL(STORED_SCHEMA))
    return stream.select(*LOG_FIELDS)


def column_of(attribute: str) -> str:
    return "a_" + attribute.replace(".", "_")


def _logs_sql(timestamp: str) -> str:
    columns = {**LOG_COLUMNS, "timestamp": timestamp}
    return (
        f"base AS (SELECT *, {_K} AS k, event_id // 6 AS trace_no, event_id // 2 AS span_no FROM events), logs AS (SELECT event_id, k, "
        + ", ".join(f"{e} AS {c}" for c, e in columns.items())
        + ", "
        + ", ".join(f"COALESCE({e}, '') AS {column_of(a)}" for a, e in ATTRIBUTES.items())
        + " FROM base)"
    )


#: the stored logs as a common table expression, attributes as columns a_<name>, '' when missing
LOGS = _logs_sql("date_trunc('milliseconds', ts)")
#: the same before they are stored, with full precision
INCOMING_LOGS = _logs_sql("ts")


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as logs: the whole text is the message, one second apart."""
    return table(spark, sf_dir, "documents").selectExpr(
        "'doc-' || CAST(doc_id AS STRING) AS id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' SECOND * doc_id AS timestamp",
        "'info' AS level",
        "text AS message",
        "source AS service",
        "'' AS trace_id",
        "'' AS span_id",
        "map('lang', lang) AS attributes",
    )


DOCUMENT_LOGS = """logs AS (SELECT 'doc-' || CAST(doc_id AS STRING) AS id,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * doc_id AS timestamp, 'info' AS level, text AS message,
 source AS service, '' AS trace_id, '' AS span_id, lang AS a_lang FROM documents)"""


def _lines(stamp, upper_level: str) -> str:
    """One line of text per log, in a format chosen by the event number.

    ``stamp`` renders a time in the format of the given name.
    """
    pid = "CAST(k + 1 AS STRING)"
    code = "CAST(200 + k AS STRING)"
    path = "'/api/items/' || CAST(k AS STRING)"
    access = f"""'10.0.0.' || CAST(k AS STRING) || ' - u' || CAST(user_no AS STRING) || ' [' || {stamp('access')} ||
 ' +0000] "GET ' || {path} || ' HTTP/1.1" ' || {code}"""
    json = f"""'{{"timestamp": "' || {stamp('iso')} || '", "level": "' || {upper_level} || '", "message": "' || message ||
 '", "service": "' || service || '", "trace_id": "' || trace_id || '", "k": ' || CAST(k AS STRING) ||
 ', "tags": {{"a": 1}}, "note": "n' || CAST(k AS STRING) || '"}}'"""
    alias = f"""'{{"lvl": "' || {upper_level} || '", "msg": "' || message || '", "app": "svc' || CAST(user_no AS STRING) ||
 '", "trace": "' || trace_id || '", "amount": 99.99, "ok": true}}'"""
    severity = f"""'{{"timestamp": "' || {stamp('plain')} || '", "severity": "' || (CASE WHEN k % 2 = 0 THEN 'CRIT' ELSE
 'Notice' END) || '", "text": "' || message || '", "name": "svc"}}'"""
    formats = [
        json,
        alias,
        severity,
        f"""{access} || ' 512 "-" "agent/1.0"'""",
        f"""'10.0.0.' || CAST(k AS STRING) || ' - - [' || {stamp('access')} || ' -0130] "PUT ' || {path} || ' HTTP/1.1" ' || {code} || ' -'""",
        f"""'<' || {pid} || '>' || {stamp('syslog')} || ' host-' || CAST(k AS STRING) || ' cron: ' || message""",
        f"""'<34>' || {stamp('syslog')} || ' host nginx[' || {pid} || ']: ' || message""",
        f"""{stamp('millis')} || '  ' || {upper_level} || ' ' || {pid} || ' --- [main] ' ||
 (CASE WHEN k % 2 = 0 THEN 'c.e.Controller' ELSE 'Controller' END) || ' : ' || message""",
        f"""{stamp('millis')} || ' ' || {upper_level} || ' user-service - ' || message""",
        f"""{stamp('docker')} || ' stderr F ' || message""",
        f"""{stamp('iso')} || ' ERROR ' || message""",
        f"""'WARN: ' || message""",
        f"""'API request completed endpoint=' || {path} || ' duration=' || CAST(k AS STRING) || 'ms status=200'""",
        f"""'Something happened to u' || CAST(user_no AS STRING) || ': ' || message""",
        f"""'{{"level": broken ' || message || '}}'""",
    ]
    cases = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(formats))
    return f"CASE event_no % {len(formats)} {cases} END"


_SPARK_STAMP = {
    "access": "date_format(timestamp, 'dd/MMM/yyyy:HH:mm:ss')",
    "syslog": "date_format(timestamp, 'MMM dd HH:mm:ss')",
    "iso": "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "plain": "date_format(timestamp, 'yyyy-MM-dd HH:mm:ss')",
    "millis": "date_format(timestamp, 'yyyy-MM-dd HH:mm:ss.SSS')",
    "docker": "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
}
_CHECK_STAMP = {
    "access": "strftime(timestamp, '%d/%b/%Y:%H:%M:%S')",
    "syslog": "strftime(timestamp, '%b %d %H:%M:%S')",
    "iso": "strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ')",
    "plain": "strftime(timestamp, '%Y-%m-%d %H:%M:%S')",
    "millis": "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g')",
    "docker": "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ')",
}


def derive_lines(events: DataFrame) -> DataFrame:
    """One text line per event, in fifteen formats: (id, value)."""
    numbered = "event_id AS event_no", "user_id AS user_no", "k"
    logs = _numbered(events).selectExpr(*numbered, *[f"{e} AS {c}" for c, e in LOG_COLUMNS.items()])
    return logs.selectExpr("id", f"{_lines(_SPARK_STAMP.get, 'upper(level)')} AS value")


def _landed(rows: DataFrame) -> DataFrame:
    """Rows spread over two tasks per core, as if as many senders had delivered them."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored text lines of all events."""

    def write(path: str) -> None:
        _landed(derive_lines(table(spark, sf_dir, "events"))).write.option("maxRecordsPerFile", 5_000_000).parquet(path)

    return spark.read.schema("id string, value string").parquet(_stored(spark, sf_dir, "lines", write))


#: the text lines as a common table expression
RAW_LINES = (
    INCOMING_LOGS
    + ", lines AS (SELECT id, "
    + _lines(_CHECK_STAMP.get, "upper(level)")
    + " AS value FROM (SELECT l.*, e.event_id AS event_no, e.user_id AS user_no FROM logs l JOIN events e USING (event_id)))"
)


def _bodies() -> str:
    """Request bodies: a single log for odd events, an array of two logs for even ones."""
    log = """'{"id": "' || id || '", "timestamp": "' || stamp || '", "level": "' || (CASE WHEN k % 4 = 0 THEN '' ELSE level END)
 || '", "message": "' || message || '", "service": "' || (CASE WHEN k % 3 = 0 THEN '' ELSE service END) || '", "attributes": {"k": ' || CAST(k AS STRING) || '}}'"""
    bare = """'{"message": "bare ' || CAST(event_no AS STRING) || '", "trace_id": "t' || CAST(k AS STRING) || '"}'"""
    return f"CASE WHEN event_no % 2 = 1 THEN {log} ELSE '[' || {log} || ', ' || {bare} || ']' END"


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON request bodies of all events: (value)."""

    def write(path: str) -> None:
        logs = _numbered(table(spark, sf_dir, "events")).selectExpr(
            "event_id AS event_no", "k", f"{_SPARK_STAMP['docker'].replace('timestamp', 'ts')} AS stamp", *[f"{e} AS {c}" for c, e in LOG_COLUMNS.items()]
        )
        _landed(logs.selectExpr(f"{_bodies()} AS value")).write.option("maxRecordsPerFile", 5_000_000).text(path)

    return spark.read.text(_stored(spark, sf_dir, "bodies", write))


def _syslog(stamp) -> str:
    pri = "CAST((event_no % 192) AS STRING)"
    new = f"""'<' || {pri} || '>1 ' || {stamp('docker')} || ' host-' || CAST(k AS STRING) || ' ' || (CASE WHEN service = '' OR k = 51 THEN '-' ELSE service END)
 || ' ' || CAST(k AS STRING) || ' ID47 ' || (CASE WHEN k % 2 = 0 THEN '-' ELSE '[origin@1 ip="10.0.0.' || CAST(k AS STRING) || '"]' END) || ' ' || message"""
    old = f"""'<' || {pri} || '>' || {stamp('syslog')} || ' host ' || (CASE WHEN k % 2 = 0 THEN 'cron' ELSE 'sshd[' || CAST(k AS STRING) || ']' END) || ': '
 || (CASE WHEN k % 5 = 0 THEN '{{"k": ' || CAST(k AS STRING) || '}}' ELSE message END)"""
    return f"CASE event_no % 3 WHEN 0 THEN {new} WHEN 1 THEN {old} ELSE 'no syslog: ' || message END"


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syslog lines of all events: (id, value, sender)."""

    def write(path: str) -> None:
        logs = _numbered(table(spark, sf_dir, "events")).selectExpr(
            "event_id AS event_no", "k", *[f"{e} AS {c}" for c, e in LOG_COLUMNS.items()]
        )
        _landed(logs.selectExpr("id", f"{_syslog(_SPARK_STAMP.get)} AS value", "'10.1.1.1:514' AS sender")).write.option("maxRecordsPerFile", 5_000_000).parquet(path)

    schema = "id string, value string, sender string"
    return spark.read.schema(schema).parquet(_stored(spark, sf_dir, "syslog", write))


_NUMBERED_LOGS = "(SELECT l.*, e.event_id AS event_no FROM logs l JOIN events e USING (event_id))"
#: request bodies and syslog lines as common table expressions
REQUEST_LOGS = INCOMING_LOGS + ", numbered AS (SELECT * FROM " + _NUMBERED_LOGS + ")"
SYSLOG_LINES = INCOMING_LOGS + f", lines AS (SELECT id, {_syslog(_CHECK_STAMP.get)} AS value FROM {_NUMBERED_LOGS})"
