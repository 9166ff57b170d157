"""Projection, predicates, joins and SQL."""

from datetime import datetime

from pyspark.sql import functions as F

from ridgelog.catalog.registry import query
from ridgelog.catalog.tables import ALL_HOURS, AS_OF, DOCUMENT_LOGS, LOGS, document_logs, event_logs, table
from ridgelog.functions.scalars import attr, attr_double, attr_long
from ridgelog.operators import filters as f
from ridgelog.operators.query import Aggregation, OrderBy, QuerySpec, run_query
from ridgelog.plans.sql import run_sql

BASIC = ("id", "timestamp", "level", "service", "message")
_SELECT = "WITH " + LOGS + " SELECT id, timestamp, level, service, message FROM logs "


def _run(spark, sf_dir, filters=(), time_range=None, **spec):
    built = QuerySpec("query", fields=spec.pop("fields", BASIC), filters=filters, time_range=time_range, **spec)
    return run_query(event_logs(spark, sf_dir), built, AS_OF)


@query("select_fields", "WITH " + LOGS + " SELECT id, level, service FROM logs")
def select_fields(spark, sf_dir):
    return _run(spark, sf_dir, fields=("id", "level", "service"))


@query("select_all", "WITH " + LOGS + " SELECT id, timestamp, level, message, service, trace_id, span_id FROM logs")
def select_all(spark, sf_dir):
    return _run(spark, sf_dir, fields=()).drop("attributes", "date_partition")


@query("filter_equals", _SELECT + "WHERE level = 'error'")
def filter_equals(spark, sf_dir):
    return _run(spark, sf_dir, [f.Filter("level", "equals", "error")])


@query("filter_not_equals", _SELECT + "WHERE service <> 'api-gateway'")
def filter_not_equals(spark, sf_dir):
    return _run(spark, sf_dir, [f.Filter("service", "not_equals", "api-gateway")])


@query("filter_contains", _SELECT + "WHERE message LIKE '%user_id=u1%ms%'")
def filter_contains(spark, sf_dir):
    return _run(spark, sf_dir, [f.Filter("message", "contains", "user_id=u1%ms")])


@query("filter_not_contains", _SELECT + "WHERE message NOT LIKE '%Re_uest%'")
def filter_not_contains(spark, sf_dir):
    return _run(spark, sf_dir, [f.Filter("message", "not_contains", "Re_uest")])


@query(
    "filter_comparisons",
    _SELECT + "WHERE timestamp > TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-25' AND service >= 'c' AND id < 'ev-9'",
)
def filter_comparisons(spark, sf_dir):
    return _run(
        spark,
        sf_dir,
        [
            f.Filter("timestamp", "greater_than", datetime(2024, 1, 5)),
            f.Filter("timestamp", "less_equal", datetime(2024, 1, 25)),
            f.Filter("service", "greater_equal", "c"),
            f.Filter("id", "less_than", "ev-9"),
        ],
    )


@query("filter_between", _SELECT + "WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def filter_between(spark, sf_dir):
    return _run(spark, sf_dir, [f.Filter("timestamp", "between", values=(datetime(2024, 1, 10), datetime(2024, 1, 20)))])


@query("filter_in", _SELECT + "WHERE level IN ('error', 'fatal') AND service NOT IN ('auth-service', '')")
def filter_in(spark, sf_dir):
    return _run(
        spark,
        sf_dir,
        [f.Filter("level", "in", values=("error", "fatal")), f.Filter("service", "not_in", values=("auth-service", ""))],
    )


def _with_nullable(spark, sf_dir):
    return event_logs(spark, sf_dir).withColumn("exception", F.col("attributes")["exception"])


@query("filter_is_null", "WITH " + LOGS + " SELECT id, level FROM logs WHERE NULLIF(a_exception, '') IS NULL")
def filter_is_null(spark, sf_dir):
    spec = QuerySpec("nulls", fields=("id", "level"), filters=[f.Filter("exception", "is_null")])
    return run_query(_with_nullable(spark, sf_dir), spec, known_fields=("id", "level", "exception"))


@query("filter_is_not_null", "WITH " + LOGS + " SELECT id, a_exception AS exception FROM logs WHERE a_exception <> ''")
def filter_is_not_null(spark, sf_dir):
    spec = QuerySpec("present", fields=("id", "exception"), filters=[f.Filter("exception", "is_not_null")])
    return run_query(_with_nullable(spark, sf_dir), spec, known_fields=("id", "exception"))


@query(
    "filter_and_or",
    _SELECT
    + """WHERE timestamp >= TIMESTAMP '2024-01-24' AND timestamp <= TIMESTAMP '2024-01-31'
 AND ((level = 'error' AND service = 'api-gateway') OR (level = 'warn' AND message LIKE '%Rate%') OR level = 'fatal')""",
)
def filter_and_or(spark, sf_dir):
    return _run(
        spark,
        sf_dir,
        [
            f.Filter("level", "equals", "error"),
            f.Filter("service", "equals", "api-gateway", logical_op="AND"),
            f.Filter("level", "equals", "warn", logical_op="OR"),
            f.Filter("message", "contains", "Rate"),
            f.Filter("level", "equals", "fatal", logical_op="OR"),
        ],
        f.TimeRange(relative="last_7d"),
    )


@query("time_range_absolute", _SELECT + "WHERE timestamp >= TIMESTAMP '2024-01-20 12:00:00'")
def time_range_absolute(spark, sf_dir):
    return _run(spark, sf_dir, time_range=f.TimeRange(start=datetime(2024, 1, 20, 12)))


@query(
    "time_range_relative",
    "WITH "
    + LOGS
    + """, spans(name, span) AS (VALUES ('last_1m', INTERVAL 1 MINUTE), ('last_5m', INTERVAL 5 MINUTE),
 ('last_15m', INTERVAL 15 MINUTE), ('last_1h', INTERVAL 1 HOUR), ('last_24h', INTERVAL 24 HOUR),
 ('last_7d', INTERVAL 7 DAY), ('last_30d', INTERVAL 30 DAY))
 SELECT name AS time_range, count(l.id) AS log_count FROM spans LEFT JOIN logs l
 ON l.timestamp >= TIMESTAMP '2024-01-31' - span AND l.timestamp <= TIMESTAMP '2024-01-31' GROUP BY name""",
)
def time_range_relative(spark, sf_dir):
    logs = event_logs(spark, sf_dir).select("timestamp")
    wide = f.time_filter(logs, AS_OF - f.RELATIVE_RANGES["last_30d"], AS_OF).agg(
        *[F.count_if(F.col("timestamp") >= f.ntz(AS_OF - span)).alias(name) for name, span in f.RELATIVE_RANGES.items()]
    )
    return wide.unpivot([], list(f.RELATIVE_RANGES), "time_range", "log_count")


@query(
    "log_search",
    "WITH "
    + LOGS
    + """ SELECT id, timestamp, level, message, service, trace_id, span_id FROM logs WHERE timestamp >= TIMESTAMP '2024-01-01'
 AND timestamp <= TIMESTAMP '2024-01-31' AND service = 'user-service' AND level = 'debug'
 AND position(lower('request COMPLETED') IN lower(message)) > 0 ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET 20""",
)
def log_search(spark, sf_dir):
    found = f.search_logs(
        event_logs(spark, sf_dir),
        start=datetime(2024, 1, 1),
        end=AS_OF,
        service="user-service",
        level="debug",
        search="request COMPLETED",
        limit=100,
        offset=20,
    )
    return found.drop("attributes", "date_partition")


@query(
    "document_search",
    "WITH " + DOCUMENT_LOGS + " SELECT id, service, message FROM logs WHERE contains(lower(message), 'license')"
    " ORDER BY timestamp DESC, id DESC LIMIT 100",
)
def document_search(spark, sf_dir):
    logs = document_logs(spark, sf_dir)
    found = f.search_logs(logs, start=datetime(2024, 1, 1), end=datetime(2034, 1, 1), search="License", limit=100)
    return found.select("id", "service", "message")


_TAIL = [
    {"field": "level", "operator": "not_equals", "value": "DEBUG"},
    {"field": "message", "operator": "contains", "value": "U1"},
    {"field": "service", "operator": "ends_with", "value": "-Service"},
    {"field": "user_id", "operator": "starts_with", "value": "U1"},
    {"field": "app", "operator": "not_contains", "value": "mapped"},
]


@query(
    "tail_filter",
    _SELECT
    + """WHERE lower(level) <> 'debug' AND contains(lower(message), 'u1') AND ends_with(lower(service), '-service')
 AND starts_with(lower(a_user_id), 'u1') AND NOT contains(lower(a_app), 'mapped')""",
)
def tail_filter(spark, sf_dir):
    return event_logs(spark, sf_dir).filter(f.tail_condition(_TAIL)).select(*BASIC)


@query(
    "export_filter",
    _SELECT
    + """WHERE timestamp >= TIMESTAMP '2024-01-02' AND timestamp <= TIMESTAMP '2024-01-30' AND level = 'error'
 AND service <> 'api-gateway' AND message LIKE '%e%' AND service > 'b' AND id < 'ev-8'""",
)
def export_filter(spark, sf_dir):
    chosen = [
        {"field": "level", "operator": "=", "value": "error"},
        {"field": "service", "operator": "!=", "value": "api-gateway"},
        {"field": "message", "operator": "contains", "value": "e"},
        {"field": "service", "operator": ">", "value": "b"},
        {"field": "id", "operator": "<", "value": "ev-8"},
        {"field": "id", "operator": "~", "value": "ignored"},
    ]
    logs = event_logs(spark, sf_dir)
    return f.export_rows(logs, chosen, start=datetime(2024, 1, 2), end=datetime(2024, 1, 30)).select(*BASIC)


@query(
    "quick_search",
    _SELECT + "WHERE contains(lower(message), 'fail') OR contains(lower(service), 'fail') OR contains(lower(level), 'fail')",
)
def quick_search(spark, sf_dir):
    return f.quick_search(event_logs(spark, sf_dir), "Fail").select(*BASIC)


@query(
    "quick_search_conversations",
    """SELECT conv_id, turn, text FROM conversations WHERE contains(lower(text), 'tion') OR contains(lower(role), 'tion')""",
)
def quick_search_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "text", "text AS message", "role AS service", "'info' AS level"
    )
    return f.quick_search(rows, "tion").select("conv_id", "turn", "text")


@query("facet_filter", _SELECT + "WHERE level = 'info' AND service = 'auth-service' AND contains(lower(message), 'checkout')")
def facet_filter(spark, sf_dir):
    logs = event_logs(spark, sf_dir)
    return f.facet_filter(logs, level="info", service="auth-service", term="CHECKOUT").select(*BASIC)


@query("attribute_filter", "WITH " + LOGS + " SELECT id, a_metric_type AS metric_type, a_app AS app FROM logs WHERE a_metric_type <> ''")
def attribute_filter(spark, sf_dir):
    rows = event_logs(spark, sf_dir).select("id", attr("metric_type").alias("metric_type"), attr("app").alias("app"))
    return rows.filter(F.col("metric_type") != "")


@query(
    "typed_attributes",
    "WITH "
    + LOGS
    + """ SELECT id, round(coalesce(TRY_CAST(a_duration_ms AS DOUBLE), -1), 6) AS duration,
 coalesce(TRY_CAST(a_request_count AS BIGINT), -1) AS requests FROM logs WHERE TRY_CAST(a_response_time AS DOUBLE) > 500
 OR TRY_CAST(a_request_count AS BIGINT) > 100""",
)
def typed_attributes(spark, sf_dir):
    rows = event_logs(spark, sf_dir).select(
        "id",
        attr_double("duration_ms").alias("duration"),
        attr_long("request_count").alias("requests"),
        attr_double("response_time").alias("response_time"),
    )
    kept = rows.filter((F.col("response_time") > 500) | (F.col("requests") > 100))
    return kept.select(
        "id",
        F.round(F.coalesce("duration", F.lit(-1.0)), 6).alias("duration"),
        F.coalesce("requests", F.lit(-1)).alias("requests"),
    )


@query("in_subquery", _SELECT + "WHERE trace_id IN (SELECT trace_id FROM logs WHERE level = 'fatal' AND trace_id <> '')")
def in_subquery(spark, sf_dir):
    logs = event_logs(spark, sf_dir)
    fatal = logs.filter((F.col("level") == "fatal") & (F.col("trace_id") != "")).select("trace_id")
    return f.in_subquery(logs.filter(F.col("trace_id") != ""), fatal, "trace_id").select(*BASIC)


@query(
    "join_event_customers",
    """SELECT n.n_name AS nation, count(*) AS event_count, round(sum(e.value), 2) AS total_value FROM events e
 JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
)
def join_event_customers(spark, sf_dir):
    """A user join in SQL: the planner picks the strategy from the table sizes."""
    for name in ("events", "customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"ridgelog_{name}")
    return spark.sql(
        """SELECT n_name AS nation, count(*) AS event_count, round(sum(value), 2) AS total_value FROM ridgelog_events
 JOIN ridgelog_customer ON user_id = c_custkey JOIN ridgelog_nation ON c_nationkey = n_nationkey GROUP BY n_name"""
    )


@query(
    "sql_parameters",
    "WITH "
    + LOGS
    + """ SELECT service, level, count(*) AS count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 744 HOUR
 AND level = 'error' GROUP BY service, level ORDER BY count DESC, service LIMIT 5""",
)
def sql_parameters(spark, sf_dir):
    text = """SELECT service, level, count(*) AS count FROM logs
 WHERE timestamp >= cast(:as_of AS timestamp_ntz) - INTERVAL :hours HOUR AND level = ${level}
 GROUP BY service, level ORDER BY count DESC, service LIMIT :limit"""
    params = {"as_of": "2024-01-31 00:00:00", "hours": ALL_HOURS, "level": "error", "limit": 5}
    return run_sql(event_logs(spark, sf_dir), text, params, max_rows=1000)


@query(
    "spec_query",
    "WITH "
    + LOGS
    + """ SELECT service, level, count(*) AS total, count(DISTINCT trace_id) AS count_distinct_trace_id,
 min(timestamp) AS first_seen FROM logs WHERE message LIKE '%e%' AND timestamp >= TIMESTAMP '2024-01-01'
 AND timestamp <= TIMESTAMP '2024-01-31' GROUP BY service, level ORDER BY total DESC, service LIMIT 20""",
)
def spec_query(spark, sf_dir):
    spec = QuerySpec(
        name="busiest",
        fields=("service", "level"),
        filters=[f.Filter("message", "contains", "e")],
        aggregations=(
            Aggregation("COUNT", alias="total"),
            Aggregation("COUNT_DISTINCT", "trace_id"),
            Aggregation("MIN", "timestamp", "first_seen"),
        ),
        group_by=("service", "level"),
        order_by=(OrderBy("total", "DESC"), OrderBy("service")),
        limit=20,
        time_range=f.TimeRange(relative="last_30d"),
    )
    return run_query(event_logs(spark, sf_dir), spec, AS_OF)
