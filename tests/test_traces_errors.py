from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ridgelog.operators import errors as e
from ridgelog.operators import traces as t

HEX32 = "a1b2c3d4e5f67890a1b2c3d4e5f67890"


def test_trace_conventions(make_logs):
    logs = make_logs(
        [
            {"trace_id": "own", "message": f"trace_id={HEX32}"},
            {"attributes": {"traceId": "zip", "traceID": "jaeger"}},
            {"message": f'trace-id: "{HEX32}"'},
            {"message": f'"traceID":"{HEX32}"'},
            {"message": 'traceId: "a1b2c3d4e5f67890"'},
            {"message": "X Root=1-67891233-abcdef;Parent=1"},
            {"message": "none"},
            {"trace_id": "x", "span_id": "log", "attributes": {"span_id": "s", "spanID": "j", "id": "z", "parent_id": "p", "parentId": "q"}},
        ]
    )
    rows = t.with_trace_ids(logs).orderBy("id").collect()
    assert [r.trace_id for r in rows[:7]] == ["own", "jaeger", HEX32, HEX32, "a1b2c3d4e5f67890", "1-67891233-abcdef", ""]
    assert (rows[7].span_id, rows[7].parent_id) == ("z", "p")


def test_operations(make_logs):
    cases = {
        "GET /api/users - Request received": "GET /api/users",
        "please delete  item": "delete  item",
        "operation: checkout, now": "checkout",
        "Method=x method: run": "run",
        "calling inventory service": "inventory",
        "executing job-7": "job-7",
        "  User data retrieved successfully": "User data retrieved",
        "two words": "two words",
        "": "unknown",
    }
    logs = make_logs([{"message": m} for m in cases])
    rows = logs.select("id", "message", t.operation_name().alias("op")).orderBy("id").collect()
    assert {r.message: r.op for r in rows} == cases


def two_traces(make_logs):
    a, b = "a" * 32, "b" * 32
    return make_logs(
        [
            {"level": "info", "message": "GET /api/users - Request received", "service": "api-gateway", "trace_id": a, "span_id": "span001"},
            {"level": "info", "message": "Fetching", "service": "user-service", "trace_id": a, "span_id": "span002",
             "attributes": {"parent_span_id": "span001", "operation": "db.query"}},
            {"level": "info", "message": "done", "service": "user-service", "trace_id": a, "span_id": "span002"},
            {"level": "info", "message": "POST /api/orders", "service": "api-gateway", "trace_id": b, "span_id": "span003"},
            {"level": "error", "message": "Database connection timeout", "service": "order-service", "trace_id": b, "span_id": "span004",
             "attributes": {"parent_span_id": "span003"}},
            {"level": "ERROR", "message": "Order creation failed", "service": "api-gateway", "trace_id": b, "span_id": "span003"},
            {"level": "info", "message": "untraced", "service": "x"},
        ]
    )


def test_spans_and_traces(make_logs):
    logs = two_traces(make_logs)
    spans = {r.span_id: r for r in t.span_summary(logs).collect()}
    assert {s: (r.operation, r.status, r.log_count, r.parent_id) for s, r in spans.items()} == {
        "span001": ("GET /api/users", "ok", 1, ""),
        "span002": ("db.query", "ok", 2, "span001"),
        "span003": ("POST /api/orders", "error", 2, ""),
        "span004": ("Database connection timeout", "error", 1, "span003"),
    }
    assert spans["span003"].duration_ms == 2000
    traces = {r.trace_id[0]: r for r in t.trace_summary(logs).collect()}
    assert (traces["a"].span_count, traces["a"].service_count, traces["a"].error_count) == (2, 2, 0)
    assert (traces["b"].span_count, traces["b"].error_count, traces["b"].duration_ms) == (2, 2, 2000)
    assert traces["b"].services == ["api-gateway", "order-service"]
    tree = {(r.parent_id, r.child_id) for r in t.span_tree(t.span_summary(logs)).collect()}
    assert tree == {("span001", "span002"), ("span003", "span004")}
    roots = {r.root_span_id for r in t.root_spans(t.span_summary(logs)).collect()}
    assert roots == {"span001", "span003"}


def test_session_gap_is_inclusive(make_logs, as_of):
    start = datetime(2024, 1, 1)
    offsets = [0, 3600, 7201, 7260]
    logs = make_logs([{"trace_id": "t", "timestamp": start + timedelta(seconds=s)} for s in offsets])
    rows = sorted(t.trace_sessions(logs).collect(), key=lambda r: r.first_log)
    assert [r.log_count for r in rows] == [2, 2]
    assert t.closed_sessions(t.trace_sessions(logs), as_of).count() == 2


MESSAGES = {
    "NullPointerException at com.example.UserService.getUser(UserService.java:45)": {"application:NullPointer", "application:StackTrace"},
    "Out of memory: Java heap space": {"resource:OutOfMemory"},
    "Connection refused: Unable to connect to Redis at localhost:6379": {"database:DatabaseConnection", "application:StackTrace"},
    "SQL Error: Deadlock detected when trying to acquire lock": {"application:Exception", "database:QueryError"},
    "HTTP 503 Service Unavailable: Payment gateway timeout": {"http:HTTP5xx", "network:Timeout"},
    "Disk space low: Only 5% free space remaining on /data": {"system:DiskSpace"},
    "Critical: System shutting down due to unrecoverable error": {"generic:Critical"},
    "permission denied": {"security:Permission"},
    "order 4040 not-found x404": set(),
    "got 404.": {"http:HTTP4xx"},
    "éfail failure": {"generic:Failed"},
    "failsafe": set(),
    "  at a.b$c(x)": {"application:StackTrace"},
    "tiſmeout TIMEſ deadlocK": {"database:QueryError"},
    "": set(),
}


def test_error_patterns(make_logs):
    logs = make_logs([{"message": m, "level": "info"} for m in MESSAGES])
    rows = e.with_detected_errors(logs).select("message", "detected_errors").collect()
    for r in rows:
        assert set(r.detected_errors) == MESSAGES[r.message], r.message


def test_error_levels_attributes_and_status(make_logs):
    logs = make_logs(
        [
            {"level": "Crit", "attributes": {"error": "x", "status_code": "503.0"}},
            {"level": "info", "attributes": {"status_code": "404", "error": ""}},
            {"level": "warn", "attributes": {"status_code": "n/a"}},
        ]
    )
    rows = e.with_detected_errors(logs).orderBy("id").collect()
    assert [r.detected_errors for r in rows] == [["level:Crit", "attribute:error", "http:503"], ["http:404"], []]
    keys = {(r.category, r.pattern) for r in e.with_hits(logs, "id").collect()}
    assert keys == {("Crit", "LogLevel"), ("attribute", "AttributeError"), ("http5xx", "HTTP503"), ("http4xx", "HTTP404")}


def test_statistics_rate_and_trend(make_logs):
    start = datetime(2024, 1, 15, 10, 0)
    logs = make_logs([{"message": "timeout", "service": f"s{i % 2}", "timestamp": start + timedelta(minutes=i)} for i in range(11)])
    counts = e.error_counts(logs)

    def at(minutes):
        return e.error_statistics(counts, start + timedelta(minutes=minutes)).first()

    row = at(10)
    assert (row["count"], row.rate, row.current_rate, row.trend) == (11, 1.1, 1.1, "stable")
    assert row.services == {"s0": 6, "s1": 5}
    assert at(13).trend == "increasing"
    assert at(16).trend == "stable"
    samples = e.error_samples(logs).collect()
    assert [s.sample for s in sorted(samples, key=lambda s: s.sample)] == list(range(1, 11))


def test_z_score_needs_history(spark):
    values = [1.0] * 9 + [1.5, 9.0]
    series = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, at int, v double")
    rows = e.with_z_score(series, "v", ["k"], "at").orderBy("at").collect()
    assert [r.is_anomaly for r in rows] == [False] * 9 + [True, True]
    assert rows[8].z_score is None


def test_hot_trace_and_hot_pattern(spark):
    """One trace and one pattern hold a third of the rows: whole results, no row lost."""
    rows = spark.range(30000).select(
        F.concat(F.lit("l"), F.col("id").cast("string")).alias("id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL '1' SECOND") * F.col("id")).alias("timestamp"),
        F.lit("error").alias("level"),
        F.lit("request timeout").alias("message"),
        F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("service"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 1000).cast("string"))).alias("trace_id"),
        F.concat(F.lit("sp"), (F.col("id") % 7).cast("string")).alias("span_id"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )
    hot = t.trace_summary(rows).filter("trace_id = 'hot'").first()
    assert (hot.log_count, hot.span_count, hot.error_count, hot.service_count) == (10000, 7, 10000, 5)
    assert t.trace_sessions(rows).filter("trace_id = 'hot'").agg(F.sum("log_count")).first()[0] == 10000
    assert e.error_counts(rows).filter("pattern = 'Timeout'").agg(F.sum("count")).first()[0] == 30000
