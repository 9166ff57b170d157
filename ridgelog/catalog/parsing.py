"""Ingest, parsing, row rules."""

from pyspark.sql import functions as F

from ridgelog.catalog.registry import query
from ridgelog.catalog.tables import (
    AS_OF,
    AS_OF_SQL,
    DOCUMENT_LOGS,
    LOGS,
    RAW_LINES,
    REQUEST_LOGS,
    SYSLOG_LINES,
    document_logs,
    event_logs,
    raw_lines,
    request_bodies,
    syslog_lines,
    table,
)
from ridgelog.functions.patterns import LINE_PATTERNS, LINE_SOURCES, LinePattern, re2
from ridgelog.functions.scalars import attr
from ridgelog.functions.timeparse import parse_timestamp
from ridgelog.operators import parsing as p
from ridgelog.operators import rules as v
from ridgelog.operators.errors import with_detected_errors
from ridgelog.session import scratch_path
from ridgelog.sources import ingest
from ridgelog.sources.syslog import decode_syslog

#: the line formats by falling priority, as the checking engine takes them
FORMATS = tuple((p.name, LINE_SOURCES[p.name]) for p in sorted(LINE_PATTERNS, key=lambda p: -p.priority))
#: group of each capture per format: message, service, level, time, other attributes
_GROUPS = {
    "syslog_rfc3164": dict(message=7, service=4, time=2, hostname=3, pid=6),
    "apache_combined": dict(time=2, ip=1, status=6),
    "nginx_access": dict(time=3, ip=1, status=7),
    "apache_common": dict(time=2, ip=1, status=6),
    "spring_boot": dict(message=6, service=5, level=2, time=1, pid=3, thread=4),
    "app_log": dict(message=4, service=3, level=2, time=1),
    "docker_log": dict(message=3, time=1, stream=2),
    "generic_timestamped": dict(message=3, level=2, time=1),
    "level_message": dict(message=2, level=1),
    "key_value": dict(message=1, kvpairs=2),
    "fallback": dict(message=1),
}
_PATTERN = "CASE " + " ".join(f"WHEN regexp_matches(value, '{r}') THEN '{n}'" for n, r in FORMATS) + " ELSE '' END"


def _capture(name: str) -> str:
    arms = [
        f"WHEN '{n}' THEN regexp_extract(value, '{r}', {_GROUPS[n][name]})" for n, r in FORMATS if name in _GROUPS[n]
    ]
    return f"(CASE pattern {' '.join(arms)} ELSE '' END)"


def _severity(word: str) -> str:
    return f"""(CASE WHEN lower({word}) IN ('emergency', 'emerg', 'panic') THEN 'fatal' WHEN lower({word}) IN ('alert', 'crit', 'critical', 'err', 'error')
 THEN 'error' WHEN lower({word}) IN ('warning', 'warn') THEN 'warn' WHEN lower({word}) = 'debug' THEN 'debug' ELSE 'info' END)"""


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"
_TIME = _capture("time")
_STAMP = f"""coalesce(try_strptime({_TIME}, ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%M:%S.%fZ', '%Y-%m-%d %H:%M:%S.%g', '%Y-%m-%d %H:%M:%S']),
 try_strptime('2024 ' || {_TIME}, '%Y %b %d %H:%M:%S'),
 try_strptime(substr({_TIME}, 1, 20), '%d/%b/%Y:%H:%M:%S') - (CASE WHEN substr({_TIME}, 22, 1) = '-' THEN -1 ELSE 1 END)
 * (TRY_CAST(substr({_TIME}, 23, 2) AS INT) * 60 + TRY_CAST(substr({_TIME}, 25, 2) AS INT)) * INTERVAL 1 MINUTE, {AS_OF_SQL})"""


def _valid(prefix: str) -> str:
    return f"""strlen({prefix}message) BETWEEN 1 AND 10000 AND {prefix}level IN ('debug', 'info', 'warn', 'error', 'fatal', 'trace')
 AND ({prefix}service = '' OR (regexp_matches({prefix}service, '^[a-zA-Z0-9_-]+$') AND strlen({prefix}service) <= 100))
 AND ({prefix}trace_id = '' OR (regexp_matches({prefix}trace_id, '^[a-fA-F0-9_-]+$') AND strlen({prefix}trace_id) <= 64))"""


def _text_member(*names: str) -> str:
    found = [f"CASE WHEN json_type(doc, '$.{n}') = 'VARCHAR' THEN json_extract_string(doc, '$.{n}') END" for n in names]
    return f"coalesce({', '.join(found)})"


def parse_sql(lines: str) -> str:
    """``lines`` (id, value) to ``parsed``: routing, validation, transformation."""
    return f"""{lines}, docs AS (SELECT id, value, CASE WHEN starts_with(trim(value, {_SPACES}), '{{') AND ends_with(trim(value, {_SPACES}), '}}')
 AND json_valid(value) THEN CAST(value AS JSON) END AS doc, {_PATTERN} AS pattern FROM lines),
 j AS (SELECT id, coalesce(try_strptime({_text_member('timestamp')}, ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d %H:%M:%S']), {AS_OF_SQL}) AS timestamp,
 coalesce(lower({_text_member('level', 'lvl')}), CASE WHEN {_text_member('severity')} IS NOT NULL THEN {_severity(_text_member('severity'))} END, 'info') AS level,
 coalesce({_text_member('message', 'msg', 'text')}, value) AS message, coalesce({_text_member('service', 'app', 'name')}, 'unknown') AS service,
 coalesce({_text_member('trace_id', 'trace')}, '') AS trace_id FROM docs WHERE doc IS NOT NULL),
 x AS (SELECT id, {_STAMP} AS timestamp, CASE WHEN pattern = 'syslog_rfc3164' THEN 'info' WHEN {_capture('level')} = '' THEN 'info' ELSE {_severity(_capture('level'))} END AS level,
 CASE WHEN {_capture('message')} = '' THEN value ELSE trim({_capture('message')}, {_SPACES}) END AS message,
 CASE WHEN {_capture('service')} = '' THEN 'unknown' ELSE trim({_capture('service')}, {_SPACES}) END AS service, '' AS trace_id FROM docs WHERE pattern <> ''),
 chosen AS (SELECT d.id, d.value, CASE WHEN j.id IS NOT NULL AND {_valid('j.')} THEN 'json' WHEN x.id IS NOT NULL AND {_valid('x.')} THEN 'regex' ELSE '' END AS parser,
 d.pattern, d.doc, struct_pack(timestamp := j.timestamp, level := j.level, message := j.message, service := j.service, trace_id := j.trace_id) AS a,
 struct_pack(timestamp := x.timestamp, level := x.level, message := x.message, service := x.service, trace_id := x.trace_id) AS b
 FROM docs d LEFT JOIN j USING (id) LEFT JOIN x USING (id)),
 picked AS (SELECT id, value, doc, parser, CASE WHEN parser = 'regex' THEN pattern ELSE '' END AS pattern, CASE parser WHEN 'json' THEN a WHEN 'regex' THEN b END AS r FROM chosen),
 parsed AS (SELECT id, value, doc, parser, pattern, r.timestamp AS timestamp, lower(r.level) AS level, trim(r.message, {_SPACES}) AS message,
 CASE WHEN r.service = '' THEN 'unknown' ELSE r.service END AS service, r.trace_id AS trace_id,
 coalesce(regexp_extract(r.message, 'user_id[=:]\\s*([a-zA-Z0-9_-]+)', 1), '') AS user_id,
 coalesce(regexp_extract(r.message, 'request_id[=:]\\s*([a-zA-Z0-9_-]+)', 1), '') AS request_id FROM picked)"""


_PARSED = parse_sql(RAW_LINES)
_FAILED = "coalesce(timestamp, TIMESTAMP '1970-01-01') AS timestamp, coalesce(level, 'info') AS level, coalesce(message, '') AS message, coalesce(service, 'unknown') AS service, coalesce(trace_id, '') AS trace_id"


def _parsed(spark, sf_dir, patterns=LINE_PATTERNS):
    return p.parse_lines(raw_lines(spark, sf_dir), as_of=AS_OF, patterns=patterns)


def _flat(rows, *attributes):
    """Comparable columns of a parse result; a failed row shows fixed values."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        "id",
        "parser",
        attr("_pattern").alias("pattern"),
        F.coalesce("timestamp", epoch).alias("timestamp"),
        "level",
        F.coalesce("message", F.lit("")).alias("message"),
        "service",
        F.coalesce("trace_id", F.lit("")).alias("trace_id"),
        *[attr(a).alias(a) for a in attributes],
    )


@query("parse_lines", f"WITH {_PARSED} SELECT id, parser, pattern, {_FAILED}, user_id, request_id FROM parsed")
def parse_lines(spark, sf_dir):
    return _flat(_parsed(spark, sf_dir), "user_id", "request_id")


_ATTRIBUTES = ("ip", "status", "hostname", "pid", "thread", "stream", "kvpairs")


@query(
    "parse_text_captures",
    f"""WITH {_PARSED} SELECT id, pattern, {', '.join(f"trim({_capture(a)}, {_SPACES}) AS {a}" for a in _ATTRIBUTES)} FROM parsed WHERE parser = 'regex'""",
)
def parse_text_captures(spark, sf_dir):
    rows = _parsed(spark, sf_dir).filter(F.col("parser") == "regex")
    return rows.select("id", attr("_pattern").alias("pattern"), *[attr(a).alias(a) for a in _ATTRIBUTES])


@query(
    "parse_json_attributes",
    f"""WITH {_PARSED} SELECT id, level, service, coalesce(json_extract_string(doc, '$.k'), '') AS k, coalesce(CAST(json_extract(doc, '$.tags') AS VARCHAR), '') AS tags,
 coalesce(json_extract_string(doc, '$.note'), '') AS note, coalesce(json_extract_string(doc, '$.amount'), '') AS amount,
 coalesce(json_extract_string(doc, '$.ok'), '') AS ok FROM parsed WHERE parser = 'json'""",
)
def parse_json_attributes(spark, sf_dir):
    rows = _parsed(spark, sf_dir).filter(F.col("parser") == "json")
    return rows.select("id", "level", "service", *[attr(a).alias(a) for a in ("k", "tags", "note", "amount", "ok")])


@query(
    "parse_json_records",
    f"""WITH {_PARSED} SELECT id, j.timestamp AS timestamp, j.level AS level, j.message AS message, j.service AS service, j.trace_id AS trace_id FROM j""",
)
def parse_json_records(spark, sf_dir):
    rows = p.parse_json_lines(raw_lines(spark, sf_dir), as_of=AS_OF).filter(F.col("record").isNotNull())
    return rows.select("id", *[F.col("record")[c].alias(c) for c in ("timestamp", "level", "message", "service", "trace_id")])


@query("parse_text_records", f"WITH {_PARSED} SELECT x.id, d.pattern, x.timestamp AS timestamp, x.level AS level, x.message AS message, x.service AS service FROM x JOIN docs d USING (id)")
def parse_text_records(spark, sf_dir):
    rows = p.parse_text_lines(raw_lines(spark, sf_dir), as_of=AS_OF).filter(F.col("record").isNotNull())
    return rows.select(
        "id",
        F.col("record.attributes")["_pattern"].alias("pattern"),
        *[F.col("record")[c].alias(c) for c in ("timestamp", "level", "message", "service")],
    )


#: a custom format above all others: captures mapped to service and a renamed attribute
BACKUP = LinePattern(
    "happened", re2(r"^Something happened to (\w+): (.*)"), ("who", "message"), 99, field_map=(("who", "service"),)
)


@query(
    "parse_custom_pattern",
    f"WITH {_PARSED} SELECT id, regexp_extract(value, '^Something happened to (\\w+): (.*)', 1) AS service, trim(regexp_extract(value, '^Something happened to (\\w+): (.*)', 2), {_SPACES}) AS message FROM lines WHERE regexp_matches(value, '^Something happened to (\\w+): (.*)')",
)
def parse_custom_pattern(spark, sf_dir):
    rows = _parsed(spark, sf_dir, p.with_custom([BACKUP]))
    return rows.filter(p.has_pattern("happened")).select("id", "service", "message")


_DOCUMENTS = parse_sql("lines AS (SELECT 'doc-' || doc_id AS id, text AS value FROM documents)")


@query("parse_documents", f"WITH {_DOCUMENTS} SELECT id, parser, pattern, {_FAILED} FROM parsed")
def parse_documents(spark, sf_dir):
    """Whole documents as lines: long texts, line breaks and odd characters."""
    lines = document_logs(spark, sf_dir).select("id", F.col("message").alias("value"))
    return _flat(p.parse_lines(lines, as_of=AS_OF))


@query(
    "parse_document_lines",
    f"""WITH {parse_sql("lines AS (SELECT doc_id || '-' || row_number() OVER () AS id, value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents))")}
 SELECT parser, pattern, count(*) AS n, count(DISTINCT message) AS messages FROM parsed GROUP BY 1, 2""",
)
def parse_document_lines(spark, sf_dir):
    """Every line of every document."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    rows = p.parse_lines(lines, as_of=AS_OF)
    return rows.groupBy("parser", attr("_pattern").alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("message").alias("messages")
    )


@query(
    "parse_statistics",
    f"WITH {_PARSED} SELECT parser, count(*) AS total, count(*) FILTER (parser <> '') AS success_count, count(*) FILTER (parser = '') AS failure_count FROM parsed GROUP BY parser",
)
def parse_statistics(spark, sf_dir):
    return p.parse_statistics(_parsed(spark, sf_dir))


@query(
    "parse_summary",
    f"""WITH {_PARSED} SELECT count(*) AS total_parsed, count(*) FILTER (parser <> '') AS success_count, count(*) FILTER (parser = '') AS failure_count,
 count(*) FILTER (parser = 'json') AS json_usage, count(*) FILTER (parser = 'regex') AS regex_usage FROM parsed""",
)
def parse_summary(spark, sf_dir):
    return p.parse_summary(_parsed(spark, sf_dir))


_GATE = f"""(value <> '' AND ((starts_with(trim(value, {_SPACES}), '{{') AND ends_with(trim(value, {_SPACES}), '}}')) OR contains(value, '[') OR contains(value, ' - ')
 OR contains(value, 'HTTP/') OR contains(value, 'INFO') OR contains(value, 'ERROR') OR contains(value, 'WARN') OR contains(value, 'DEBUG')))"""


@query("parse_gate", f"WITH {RAW_LINES} SELECT id, {_GATE} AS parse FROM lines")
def parse_gate(spark, sf_dir):
    return raw_lines(spark, sf_dir).select("id", p.needs_parsing("value").alias("parse"))


@query(
    "parse_and_merge",
    f"""WITH {_PARSED}, m AS (SELECT p.*, {_GATE} AS gate, {_GATE} AND parser <> '' AS ok FROM parsed p) SELECT id, gate AS parse_attempted, ok AS success,
 CASE WHEN ok THEN timestamp ELSE TIMESTAMP '2024-01-30' END AS timestamp, CASE WHEN ok THEN level ELSE 'notice' END AS level,
 CASE WHEN ok THEN message ELSE value END AS message, CASE WHEN ok AND service <> 'unknown' THEN service ELSE 'collector' END AS service,
 CASE WHEN ok AND trace_id <> '' THEN trace_id ELSE 'orig' END AS trace_id, CASE WHEN ok AND parser = 'regex' AND pattern IN ('apache_combined', 'apache_common', 'nginx_access')
 THEN {_capture('ip')} ELSE 'none' END AS ip, 'file' AS source FROM m""",
)
def parse_and_merge(spark, sf_dir):
    logs = raw_lines(spark, sf_dir).select(
        "id",
        F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("timestamp"),
        F.lit("notice").alias("level"),
        F.col("value").alias("message"),
        F.lit("collector").alias("service"),
        F.lit("orig").alias("trace_id"),
        F.lit("").alias("span_id"),
        F.create_map(F.lit("ip"), F.lit("none"), F.lit("source"), F.lit("file")).alias("attributes"),
    )
    rows = p.parse_stored_messages(logs, as_of=AS_OF)
    return rows.select(
        "id", "parse_attempted", "success", "timestamp", "level", "message", "service", "trace_id",
        attr("ip").alias("ip"), attr("source").alias("source"),
    )


@query(
    "timestamp_layouts",
    """SELECT o_orderkey, o_orderdate AS iso, o_orderdate - INTERVAL 90 MINUTE AS offset_, o_orderdate AS plain, o_orderdate AS slashed, o_orderdate AS access, o_orderdate AS seconds,
 o_orderdate + INTERVAL 10000 DAY AS millis, make_timestamp(2024, month(o_orderdate), day(o_orderdate), 0, 0, 0) AS yearless FROM orders""",
)
def timestamp_layouts(spark, sf_dir):
    """The order dates written in every accepted layout and read back."""
    orders = table(spark, sf_dir, "orders")
    d, epoch = F.col("o_orderdate"), F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    texts = {
        "iso": F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'.000Z'"),
        "offset_": F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")),
        "plain": F.date_format(d, "yyyy-MM-dd HH:mm:ss,SSS"),
        "slashed": F.date_format(d, "yyyy/MM/dd HH:mm:ss"),
        "access": F.concat(F.date_format(d, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000")),
        "seconds": epoch.cast("string"),
        "millis": ((epoch + 10000 * 86400) * 1000).cast("string"),
        "yearless": F.date_format(d, "MMM dd HH:mm:ss"),
    }
    return orders.select("o_orderkey", *[parse_timestamp(t, AS_OF).alias(n) for n, t in texts.items()])


@query(
    "severity_levels",
    f"""WITH words(i, word) AS (VALUES (0, 'EMERG'), (1, 'panic'), (2, 'Alert'), (3, 'crit'), (4, 'err'), (5, 'warning'), (6, 'notice'), (7, 'DEBUG'), (8, 'FATAL'), (9, 'trace'))
 SELECT event_id, word, {_severity('word')} AS level FROM events JOIN words ON user_id % 10 = i""",
)
def severity_levels(spark, sf_dir):
    words = ("EMERG", "panic", "Alert", "crit", "err", "warning", "notice", "DEBUG", "FATAL", "trace")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("user_id") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", word.alias("word"))
    return rows.withColumn("level", p.severity_to_level("word"))


# -- ingest -----------------------------------------------------------------------------------


@query(
    "ingest_bodies",
    f"""WITH {REQUEST_LOGS} SELECT id, timestamp, CASE WHEN k % 4 = 0 THEN 'info' ELSE level END AS level, message, CASE WHEN k % 3 = 0 OR service = '' THEN 'unknown' ELSE service END AS service,
 '' AS trace_id, CAST(k AS VARCHAR) AS k FROM numbered UNION ALL SELECT 'generated', {AS_OF_SQL}, 'info', 'bare ' || event_no, 'unknown', 't' || k, '' FROM numbered WHERE event_no % 2 = 0""",
)
def ingest_bodies(spark, sf_dir):
    logs = ingest.decode_bodies(request_bodies(spark, sf_dir), as_of=AS_OF)
    bare = F.col("message").startswith("bare ")
    return logs.select(
        F.when(bare, F.lit("generated")).otherwise(F.col("id")).alias("id"),
        "timestamp", "level", "message", "service", "trace_id", attr("k").alias("k"),
    )


@query(
    "read_json_files",
    f"""WITH {REQUEST_LOGS} SELECT id, timestamp, CASE WHEN k % 4 = 0 THEN 'info' ELSE level END AS level, message, CASE WHEN k % 3 = 0 OR service = '' THEN 'unknown' ELSE service END AS service,
 '' AS trace_id FROM numbered UNION ALL SELECT 'generated', {AS_OF_SQL}, 'info', 'bare ' || event_no, 'unknown', 't' || k FROM numbered WHERE event_no % 2 = 0""",
)
def read_json_files(spark, sf_dir):
    """Lines of objects and arrays in files, between as many lines that were cut off."""
    path, bodies = scratch_path(spark, "json-files"), request_bodies(spark, sf_dir)
    bodies.write.text(path)
    bodies.select(F.expr("left(value, length(value) - 3)")).write.mode("append").text(path)
    logs = ingest.read_json_logs(spark, path, as_of=AS_OF)
    bare = F.when(F.col("message").startswith("bare "), F.lit("generated")).otherwise(F.col("id"))
    return logs.select(bare.alias("id"), "timestamp", "level", "message", "service", "trace_id")


_ODD_BODIES = """CASE doc_id % 5 WHEN 0 THEN left(text, 60) WHEN 1 THEN '{"message": "' || lang || '", "service": 7}' WHEN 2 THEN '[{"message": "a"}, 1]'
 WHEN 3 THEN '"' || lang || '"' ELSE '{"message": "' || lang END"""


@query(
    "ingest_rejects",
    """SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'array with elements that are no logs' WHEN 3 THEN 'no log or array of logs' ELSE 'malformed JSON' END AS reason
 FROM documents WHERE doc_id % 5 <> 1 AND NOT (doc_id % 5 = 0 AND trim(left(text, 60)) = '')""",
)
def ingest_rejects(spark, sf_dir):
    bodies = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_ODD_BODIES} AS value")
    return ingest.rejected_bodies(bodies).select("doc_id", "reason")


@query("ingest_accepted", "SELECT lang AS message, '7' AS service, 'info' AS level, count(*) AS row_count FROM documents WHERE doc_id % 5 = 1 GROUP BY 1")
def ingest_accepted(spark, sf_dir):
    """The other side of ``ingest_rejects``: nothing but whole logs gets in."""
    bodies = table(spark, sf_dir, "documents").selectExpr(f"{_ODD_BODIES} AS value")
    return ingest.decode_bodies(bodies, as_of=AS_OF).groupBy("message", "service", "level").agg(F.count(F.lit(1)).alias("row_count"))


_ODD_CODES = "CASE event_id % 6 WHEN 0 THEN '99999999999' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN '404' WHEN 4 THEN '503.9' ELSE '-1e400' END"


@query("hostile_status_codes", "SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'http:404' WHEN 4 THEN 'http:503' ELSE '' END AS tags FROM events")
def hostile_status_codes(spark, sf_dir):
    """Status codes beyond any integer are no status, and end no job."""
    logs = table(spark, sf_dir, "events").selectExpr("event_id", "'fine' AS message", "'info' AS level", f"map('status_code', {_ODD_CODES}) AS attributes")
    return with_detected_errors(logs).select("event_id", F.array_join("detected_errors", ",").alias("tags"))


@query(
    "bulk_summary",
    f"""WITH {REQUEST_LOGS} SELECT 'batch-' || (event_no // 500) AS batch, count(*) AS log_count, min(date_trunc('milliseconds', timestamp)) AS first_timestamp,
 max(date_trunc('milliseconds', timestamp)) AS last_timestamp FROM numbered GROUP BY 1""",
)
def bulk_summary(spark, sf_dir):
    number = F.substring("id", 4, 20).cast("bigint")
    logs = event_logs(spark, sf_dir).withColumn("batch", F.concat(F.lit("batch-"), F.floor(number / 500).cast("string")))
    return ingest.bulk_summary(logs)


@query(
    "ingest_lines",
    f"""WITH {RAW_LINES}, d AS (SELECT id, value, CASE WHEN starts_with(trim(value), '{{') AND json_valid(value) THEN CAST(value AS JSON) END AS doc FROM lines),
 t AS (SELECT *, doc IS NOT NULL AND (json_extract_string(doc, '$.timestamp') IS NULL OR regexp_matches(json_extract_string(doc, '$.timestamp'), 'T.*Z')) AS log FROM d)
 SELECT CASE WHEN log THEN coalesce(strptime(json_extract_string(doc, '$.timestamp'), '%Y-%m-%dT%H:%M:%SZ'), {AS_OF_SQL}) ELSE {AS_OF_SQL} END AS timestamp,
 CASE WHEN log THEN coalesce(json_extract_string(doc, '$.level'), 'info') ELSE 'info' END AS level,
 CASE WHEN log THEN coalesce(json_extract_string(doc, '$.message'), '') ELSE value END AS message,
 CASE WHEN log THEN coalesce(nullif(json_extract_string(doc, '$.service'), ''), 'tcp-client') ELSE 'tcp-client' END AS service,
 CASE WHEN log THEN coalesce(json_extract_string(doc, '$.trace_id'), '') ELSE '' END AS trace_id FROM t""",
)
def ingest_lines(spark, sf_dir):
    logs = ingest.decode_lines(raw_lines(spark, sf_dir), as_of=AS_OF)
    return logs.select("timestamp", "level", "message", "service", "trace_id")


_S5 = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.*)$"
_S3 = r"^<(\d+)>(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?)(\[(\d+)\])?:\s*(.*)$"
_SEVERITIES = "['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info', 'debug']"
_FACILITIES = "['kernel', 'user', 'mail', 'system', 'security', 'syslogd', 'line-printer', 'network-news', 'uucp', 'clock', 'security2', 'ftp', 'ntp', 'log-audit', 'log-alert', 'clock2', 'local0', 'local1', 'local2', 'local3', 'local4', 'local5', 'local6', 'local7']"


@query(
    "decode_syslog",
    f"""WITH {SYSLOG_LINES}, s AS (SELECT *, CASE WHEN regexp_matches(value, '{_S5}') THEN 'RFC5424' WHEN regexp_matches(value, '{_S3}') THEN 'RFC3164' ELSE 'unknown' END AS format,
 TRY_CAST(regexp_extract(value, '^<(\\d+)>', 1) AS INT) AS pri FROM lines)
 SELECT id, format, CASE format WHEN 'RFC5424' THEN strptime(regexp_extract(value, '{_S5}', 3), '%Y-%m-%dT%H:%M:%S.%fZ')
 WHEN 'RFC3164' THEN strptime('2024 ' || regexp_extract(value, '{_S3}', 2), '%Y %b %d %H:%M:%S') ELSE {AS_OF_SQL} END AS timestamp,
 CASE format WHEN 'unknown' THEN 'info' ELSE {_SEVERITIES}[(pri & 7) + 1] END AS level,
 CASE format WHEN 'RFC5424' THEN regexp_extract(value, '{_S5}', 5) WHEN 'RFC3164' THEN regexp_extract(value, '{_S3}', 4) ELSE 'syslog' END AS service,
 CASE format WHEN 'RFC5424' THEN regexp_extract(value, '{_S5}', 9) WHEN 'RFC3164' THEN regexp_extract(value, '{_S3}', 7) ELSE value END AS message,
 CASE format WHEN 'unknown' THEN '' ELSE coalesce({_FACILITIES}[(pri >> 3) + 1], '') END AS facility,
 CASE format WHEN 'RFC5424' THEN regexp_extract(value, '{_S5}', 4) WHEN 'RFC3164' THEN regexp_extract(value, '{_S3}', 3) ELSE '' END AS hostname,
 CASE format WHEN 'RFC3164' THEN regexp_extract(value, '{_S3}', 6) ELSE '' END AS pid, CASE format WHEN 'RFC5424' THEN regexp_extract(value, '{_S5}', 6) ELSE '' END AS procid,
 CASE format WHEN 'RFC5424' THEN regexp_extract(value, '{_S5}', 8) ELSE '' END AS structured_data,
 CASE WHEN format = 'RFC3164' AND starts_with(regexp_extract(value, '{_S3}', 7), '{{') AND ends_with(value, '}}') THEN regexp_extract(value, '{_S3}', 7) ELSE '' END AS raw_message,
 '10.1.1.1:514' AS source_addr FROM s""",
)
def decode_syslog_lines(spark, sf_dir):
    logs = decode_syslog(syslog_lines(spark, sf_dir), as_of=AS_OF, source_column="sender")
    names = ("facility", "hostname", "pid", "procid", "structured_data", "raw_message", "source_addr", "format")
    return logs.select("id", "timestamp", "level", "service", "message", *[attr(n).alias(n) for n in names])


@query(
    "hostile_syslog",
    f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_SEVERITIES}[((event_id * 9000000007) & 7) + 1] ELSE 'emergency' END AS level,
 CASE WHEN event_id % 2 = 0 THEN coalesce({_FACILITIES}[least((event_id * 9000000007) >> 3, 1000) + 1], '') ELSE 'kernel' END AS facility FROM events""",
)
def hostile_syslog(spark, sf_dir):
    """A PRI of many digits names no facility; one beyond 64 bits counts as 0."""
    pri = "CASE WHEN event_id % 2 = 0 THEN CAST(event_id * 9000000007 AS STRING) ELSE '9' || lpad(CAST(event_id AS STRING), 30, '9') END"
    lines = table(spark, sf_dir, "events").selectExpr("event_id", f"'<' || {pri} || '>Jan 15 10:30:00 host app: text' AS value")
    logs = decode_syslog(lines, as_of=AS_OF)
    return logs.select("event_id", "level", attr("facility").alias("facility"))


@query(
    "agent_fields",
    f"WITH {LOGS} SELECT id, CASE WHEN a_app <> '' THEN a_app ELSE 'agent' END AS app, 'eu' AS region, CASE WHEN a_exception <> '' THEN a_exception ELSE a_error END AS error FROM logs",
)
def agent_fields(spark, sf_dir):
    from ridgelog.functions.scalars import present_attributes

    logs = event_logs(spark, sf_dir).withColumn("attributes", present_attributes())
    rows = logs.withColumn("failure", attr("exception"))
    rows = ingest.with_agent_fields(rows, {"app": "agent", "region": "eu"}, "failure")
    return rows.select("id", attr("app").alias("app"), attr("region").alias("region"), attr("error").alias("error"))


# -- row rules --------------------------------------------------------------------------------


def _violations_sql(message: str, level: str, service: str, trace: str) -> str:
    allowed = "('debug', 'info', 'warn', 'error', 'fatal', 'trace')"
    checks = (
        ("required:message", f"{message} = ''"),
        ("constraint:level:allowed_values", f"{level} <> '' AND {level} NOT IN {allowed}"),
        ("constraint:message:required", f"{message} = ''"),
        ("constraint:message:max_length", f"strlen({message}) > 10000"),
        ("constraint:service:max_length", f"strlen({service}) > 100"),
        ("constraint:service:pattern", f"{service} <> '' AND NOT regexp_matches({service}, '^[a-zA-Z0-9_-]+$')"),
        ("constraint:trace_id:max_length", f"strlen({trace}) > 64"),
        ("constraint:trace_id:pattern", f"{trace} <> '' AND NOT regexp_matches({trace}, '^[a-fA-F0-9_-]+$')"),
        ("rule:message_required", f"{message} = ''"),
        ("rule:level_enum", f"{level} <> '' AND {level} NOT IN {allowed}"),
        ("rule:message_length", f"strlen({message}) > 10000"),
        ("rule:service_format", f"{service} <> '' AND NOT regexp_matches({service}, '^[a-zA-Z0-9_-]+$')"),
    )
    cases = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_CHECKED = f"checked AS (SELECT *, {_violations_sql('message', 'level', 'service', 'trace_id')} AS broken FROM logs)"


def _join(rows):
    return rows.withColumn("violations", F.array_join("violations", ","))


@query("rule_violations", f"WITH {LOGS}, {_CHECKED} SELECT id, array_to_string(broken, ',') AS violations, len(broken) = 0 AS is_valid FROM checked")
def rule_violations(spark, sf_dir):
    return _join(v.with_violations(event_logs(spark, sf_dir))).select("id", "violations", "is_valid")


@query("rule_violations_documents", f"WITH {DOCUMENT_LOGS}, {_CHECKED} SELECT id, array_to_string(broken, ',') AS violations, len(broken) = 0 AS is_valid FROM checked")
def rule_violations_documents(spark, sf_dir):
    return _join(v.with_violations(document_logs(spark, sf_dir))).select("id", "violations", "is_valid")


@query("valid_rows", f"WITH {LOGS}, {_CHECKED} SELECT id, level, service FROM checked WHERE len(broken) = 0")
def valid_rows(spark, sf_dir):
    return v.validate(event_logs(spark, sf_dir)).select("id", "level", "service")


@query("rejected_rows", f"WITH {LOGS}, {_CHECKED} SELECT id, array_to_string(broken, ',') AS violations FROM checked WHERE len(broken) > 0")
def rejected_rows(spark, sf_dir):
    return _join(v.rejects(event_logs(spark, sf_dir))).select("id", "violations")


@query("validity_report", f"WITH {LOGS}, {_CHECKED} SELECT rule, service, count(*) AS failures FROM (SELECT service, unnest(broken) AS rule FROM checked) GROUP BY 1, 2")
def validity_report(spark, sf_dir):
    return v.validity_report(event_logs(spark, sf_dir))


CUSTOM_RULES = v.RuleSet(
    required=("user_id",),
    constraints=(
        v.Constraint("status_code", pattern=r"^[45]\d\d$", min_length=3, max_length=3),
        v.Constraint("operation", required=True, allowed=("db.query", "cache.get")),
    ),
    validations=(
        v.ValidationRule("short_message", "message", "range", max_length=60),
        v.ValidationRule("has_app", "app", "required"),
        v.ValidationRule("known_exception", "exception", "enum", allowed=("java.io.IOException",)),
    ),
)


@query(
    "custom_rule_violations",
    f"""WITH {LOGS}, checked AS (SELECT id, list_filter([CASE WHEN a_user_id = '' THEN 'required:user_id' END,
 CASE WHEN a_status_code <> '' AND NOT regexp_matches(a_status_code, '^[45]\\d\\d$') THEN 'constraint:status_code:pattern' END,
 CASE WHEN a_operation = '' THEN 'constraint:operation:required' END, CASE WHEN strlen(message) > 60 THEN 'rule:short_message' END,
 CASE WHEN a_app = '' THEN 'rule:has_app' END, CASE WHEN a_exception NOT IN ('', 'java.io.IOException') THEN 'rule:known_exception' END], lambda x: x IS NOT NULL) AS broken FROM logs)
 SELECT id, array_to_string(broken, ',') AS violations, len(broken) = 0 AS is_valid FROM checked""",
)
def custom_rule_violations(spark, sf_dir):
    return _join(v.with_violations(event_logs(spark, sf_dir), CUSTOM_RULES)).select("id", "violations", "is_valid")


@query(
    "transform_rows",
    f"""WITH {LOGS} SELECT id, lower(level) AS level, trim(message, {_SPACES}) AS message, CASE WHEN service <> '' THEN service WHEN a_app <> '' THEN a_app ELSE 'unknown' END AS service,
 CASE WHEN regexp_matches(message, 'user_id[=:]\\s*([a-zA-Z0-9_-]+)') THEN regexp_extract(message, 'user_id[=:]\\s*([a-zA-Z0-9_-]+)', 1) ELSE a_user_id END AS user_id,
 regexp_extract(message, 'request_id[=:]\\s*([a-zA-Z0-9_-]+)', 1) AS request_id, '' AS app FROM logs""",
)
def transform_rows(spark, sf_dir):
    rows = v.transform(event_logs(spark, sf_dir))
    return rows.select("id", "level", "message", "service", *[attr(a).alias(a) for a in ("user_id", "request_id", "app")])


ENRICH_RULES = v.RuleSet(
    mappings=(("status_code", "status"),),
    defaults={"team": "core", "operation": "none"},
    transforms=(
        v.TransformRule("upper", "normalize", "exception", function="uppercase"),
        v.TransformRule("code", "extract", "exception_message", "span_id", pattern=r"code (\d+)"),
        v.TransformRule("when", "enrich", target="parsed_at"),
        v.TransformRule("where", "enrich", target="environment", replacement="production"),
        v.TransformRule("nothing", "filter"),
    ),
)


@query(
    "enrich_rows",
    f"""WITH {LOGS} SELECT id, a_status_code AS status, '' AS status_code, 'core' AS team, CASE WHEN a_operation <> '' THEN a_operation ELSE 'none' END AS operation,
 upper(a_exception) AS exception, CASE WHEN a_exception_message <> '' THEN regexp_extract(a_exception_message, 'code (\\d+)', 1) ELSE span_id END AS span_id,
 '2024-01-31T00:00:00Z' AS parsed_at, 'production' AS environment FROM logs""",
)
def enrich_rows(spark, sf_dir):
    rows = v.transform(event_logs(spark, sf_dir), ENRICH_RULES, AS_OF)
    names = ("status", "status_code", "team", "operation", "exception", "parsed_at", "environment")
    return rows.select("id", "span_id", *[attr(a).alias(a) for a in names])
