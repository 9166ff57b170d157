"""Streams over the files of the stored table, drained into tables.

Windows and sessions are emitted once the watermark has passed them, so the SQL
counterparts leave out the ones that are still open.
"""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ridgelog.catalog.errors import hits_sql
from ridgelog.catalog.registry import query
from ridgelog.catalog.tables import LOGS, derive_logs, event_logs, log_stream, table
from ridgelog.catalog.traces import _SESSIONS, _TRACED
from ridgelog.operators.errors import with_hits
from ridgelog.session import folder_system, scratch_path
from ridgelog.storage.table import publish_days, read_logs
from ridgelog.streaming import clients as tails
from ridgelog.streaming import delivery
from ridgelog.streaming import errors as live
from ridgelog.streaming import jobs as j

W = "WITH " + LOGS + " "
_TAIL_ID = "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g')"
_NOW = "(SELECT max(timestamp) FROM logs) - INTERVAL 10 MINUTE"


@query("live_tail", W + f"SELECT {_TAIL_ID} AS id, timestamp, level, service, message, trace_id FROM logs WHERE lower(level) <> 'debug' AND starts_with(lower(a_user_id), 'u1')")
def live_tail(spark, sf_dir):
    filters = [
        {"field": "level", "operator": "!=", "value": "debug"},
        {"field": "user_id", "operator": "starts_with", "value": "U1"},
    ]
    return j.run_available(j.tail_stream(log_stream(spark, sf_dir), filters), "tail")


@query(
    "tail_poll",
    W + f"SELECT {_TAIL_ID} AS id, timestamp, level, service, message, trace_id FROM logs WHERE timestamp > TIMESTAMP '2024-01-15' ORDER BY timestamp, logs.id LIMIT 100",
)
def tail_poll(spark, sf_dir):
    return j.tail_batch(event_logs(spark, sf_dir), datetime(2024, 1, 15))


@query("tail_pages", W + "SELECT id, timestamp, level FROM logs WHERE timestamp > TIMESTAMP '2024-01-01'")
def tail_pages(spark, sf_dir):
    """A replay of the tail in pages of fixed size, in which many logs share a time; all pages together are the logs."""
    logs = event_logs(spark, sf_dir)
    days = logs.withColumn("timestamp", F.date_trunc("day", "timestamp").cast("timestamp_ntz"))
    pages = j.tail_replay(days, datetime(2023, 12, 31))
    ids = pages.groupBy("page").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= j.TAIL_BATCH).join(pages, "page").select("id")
    return logs.filter("timestamp > timestamp_ntz'2024-01-01'").join(ids, "id").select("id", "timestamp", "level")


_UNTIMED = "CASE WHEN event_id % 97 <> 0 THEN timestamp END"


@query("late_ingest", W + f"SELECT strftime({_UNTIMED}, '%Y-%m-%d') AS day, count(*) AS row_count, count(DISTINCT id) AS ids FROM logs GROUP BY 1")
def late_ingest(spark, sf_dir):
    """Deliveries of whole stretches of days, the newest first, and some days twice; a few logs have no time.

    Late logs are kept and repeated ones removed. A micro-batch takes up to eight files, the size of a delivery, so
    no task sees a whole delivery.
    """
    source, landing, path = scratch_path(spark, "arriving"), scratch_path(spark, "landing"), scratch_path(spark, "published")
    logs = event_logs(spark, sf_dir).drop("date_partition")
    day, untimed = F.dayofmonth("timestamp"), F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 97 == 0
    for first, last in ((21, 31), (1, 10), (8, 22)):
        delivery = logs.filter((day >= first) & (day <= last)).withColumn("timestamp", F.when(~untimed, F.col("timestamp")))
        delivery.write.mode("append").parquet(source)
    stream = j.stream_files(spark, source, logs.schema, files_per_trigger=8)
    j.append_sink(stream, landing, scratch_path(spark, "landing-checkpoint"), trigger={"availableNow": True}).awaitTermination()
    days = [r[0] for r in read_logs(spark, landing).select("date_partition").distinct().collect()]
    publish_days(spark, landing, path, days)
    return read_logs(spark, path).groupBy(F.col("date_partition").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("id").alias("ids")
    )


@query("stream_retry", W + f"SELECT id, {_UNTIMED} AS timestamp, level, service, message FROM logs")
def stream_retry(spark, sf_dir):
    """Delivery to a sink that breaks: a third of the batches succeeds at the third attempt, each broken one having
    left half of its rows, a third is set aside and delivered later, and all logs stand in the table once.
    """
    source, path = scratch_path(spark, "arriving"), scratch_path(spark, "delivery")
    untimed = F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 97 == 0
    logs = event_logs(spark, sf_dir).drop("date_partition").withColumn("timestamp", F.when(~untimed, F.col("timestamp")))
    logs.write.parquet(source)
    system, folder = folder_system(spark, source)
    sixth = system.getContentSummary(folder).getLength() // 6 + 1
    write, seen = delivery.landing_writer(path), Counter()

    def breaking(rows, batch):
        seen[batch] += 1
        if seen[batch] <= (2, 3, 0)[batch % 3]:
            write(rows.filter(F.crc32("id") % 2 == 0), batch)
            raise OSError("the sink broke off")
        write(rows, batch)

    stream = delivery.files_by_size(spark, source, logs.schema, sixth)
    options = {"write": breaking, "backoff": 0.01}
    delivery.delivering_sink(stream, path, scratch_path(spark, "delivery-checkpoint"), trigger={"availableNow": True}, **options).awaitTermination()
    delivery.redeliver(spark, path, **options)
    return delivery.delivered_rows(spark, path).select("id", "timestamp", "level", "service", "message")


@query(
    "stream_enrichment",
    f"WITH {hits_sql(_TRACED, 'a_error')}, tags AS (SELECT id, string_agg(tag, ',' ORDER BY position) AS tags FROM hits GROUP BY id)"
    " SELECT i.id, i.trace_id, i.span_id, coalesce(tags, '') AS detected_errors FROM ids i LEFT JOIN tags USING (id)",
)
def stream_enrichment(spark, sf_dir):
    rows = j.enrich(log_stream(spark, sf_dir)).select(
        "id", "trace_id", "span_id", F.array_join("detected_errors", ",").alias("detected_errors")
    )
    return j.run_available(rows, "enriched")


@query(
    "stream_traces",
    f"WITH {_SESSIONS}, closed AS (SELECT trace_id, min(timestamp) AS first_log, max(timestamp) AS last_log, count(*) AS log_count, count(*) FILTER (failed) AS error_count,"
    " coalesce(string_agg(DISTINCT NULLIF(service, ''), ',' ORDER BY NULLIF(service, '')), '') AS services, count(DISTINCT NULLIF(span_id, '')) AS span_count,"
    " (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000 AS duration_ms FROM numbered GROUP BY trace_id, no)"
    f" SELECT * FROM closed WHERE last_log + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM traced) - INTERVAL 10 MINUTE",
)
def stream_traces(spark, sf_dir):
    traces = j.trace_state(log_stream(spark, sf_dir)).withColumn("services", F.array_join("services", ","))
    return j.run_available(traces, "traces")


_HITS = hits_sql(LOGS)


@query(
    "stream_errors",
    f"""WITH {_HITS} SELECT date_trunc('hour', timestamp) AS window_start, category, pattern, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
 FROM found GROUP BY 1, 2, 3 HAVING date_trunc('hour', min(timestamp)) + INTERVAL 1 HOUR <= {_NOW}""",
)
def stream_errors(spark, sf_dir):
    return j.run_available(j.error_state(log_stream(spark, sf_dir)), "errors")


@query(
    "stream_error_totals",
    f"WITH {_HITS} SELECT category, pattern, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM found GROUP BY 1, 2",
)
def stream_error_totals(spark, sf_dir):
    hits = with_hits(log_stream(spark, sf_dir), "timestamp").select(
        "category", "pattern", F.lit(1).cast("bigint").alias("count"),
        F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"),
    )
    path, checkpoint = scratch_path(spark, "totals"), scratch_path(spark, "totals-checkpoint")
    query_ = j.totals_sink(
        hits, path, checkpoint, ["category", "pattern"], ["count"], ["first_seen"], ["last_seen"], trigger={"availableNow": True}
    )
    query_.awaitTermination()
    return j.latest_totals(spark, path)


@query(
    "stream_rates",
    W
    + f""", b AS (SELECT time_bucket(INTERVAL 10 MINUTE, timestamp) AS bucket, count(*) AS n FROM logs GROUP BY 1), w AS (SELECT bucket + (i + 1) * INTERVAL 10 MINUTE AS window_end, n
 FROM b, range(6) r(i)) SELECT window_end, CAST(sum(n) AS BIGINT) AS events, round(sum(n) / 3600.0, 6) AS rate FROM w GROUP BY 1 HAVING window_end <= {_NOW}""",
)
def stream_rates(spark, sf_dir):
    rates = j.rate_state(log_stream(spark, sf_dir).select("timestamp"), window=3600, slide=600)
    return j.run_available(rates, "rates").withColumn("rate", F.round("rate", 6))


@query(
    "stream_hourly_counts",
    W
    + f"""SELECT date_trunc('hour', timestamp) AS window_start, service, level, count(*) AS count FROM logs GROUP BY 1, 2, 3
 HAVING date_trunc('hour', min(timestamp)) + INTERVAL 1 HOUR <= {_NOW}""",
)
def stream_hourly_counts(spark, sf_dir):
    counts = j.window_counts(log_stream(spark, sf_dir), ["service", "level"], "1 hour")
    return j.run_available(counts, "hourly")


@query("stream_deduplication", W + "SELECT id, timestamp, level FROM logs")
def stream_deduplication(spark, sf_dir):
    """Every log is delivered twice."""
    logs = log_stream(spark, sf_dir).select("id", "timestamp", "level")
    return j.run_available(j.deduplicate(logs.union(logs), "40 days"), "deduplicated")


@query("stream_ingest", W + f"SELECT strftime({_UNTIMED}, '%Y-%m-%d') AS day, service, count(*) AS row_count, min(id) AS first_id FROM logs GROUP BY 1, 2")
def stream_ingest(spark, sf_dir):
    """Events stream into a landing table, whose days are then published to a stored table; a few have no time."""
    events = j.stream_files(spark, sf_dir, table(spark, sf_dir, "events").schema, glob="events.parquet")
    events = events.withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "published")
    sink = j.append_sink(derive_logs(events), landing, scratch_path(spark, "landing-checkpoint"), trigger={"availableNow": True})
    sink.awaitTermination()
    days = [r[0] for r in read_logs(spark, landing).select("date_partition").distinct().collect()]
    publish_days(spark, landing, path, days)
    rows = read_logs(spark, path)
    return rows.groupBy(F.col("date_partition").cast("string").alias("day"), "service").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("id").alias("first_id")
    )


#: how late logs may come in the next streams, and the last minute that is counted then
_LATE = "7 days"
_SETTLED = "(SELECT max(timestamp) FROM logs) - INTERVAL 7 DAY"


def _shuffled_stream(spark, sf_dir):
    """The logs in deliveries of three days, one a batch, neighbours in the wrong order and the oldest after all that may come late.

    So every delivery but the last brings logs older than some that came before, never by more than a week. A delivery has as
    many files as the cluster has cores, so no task writes or reads a whole one.
    """
    path, files = scratch_path(spark, "shuffled"), max(2, spark.sparkContext.defaultParallelism)
    logs = event_logs(spark, sf_dir).drop("date_partition")
    part = F.floor((F.dayofmonth("timestamp") - 1) / 3)
    for k in (1, 0, 3, 2, 5, 4, 7, 6, 9, 8, 10):
        logs.filter(part == k).repartition(files).write.mode("append").parquet(path)
    return j.stream_files(spark, path, logs.schema, files_per_trigger=files)


@query(
    "stream_error_statistics",
    f"""WITH {_HITS}, due AS (SELECT * FROM found WHERE date_trunc('minute', timestamp) + INTERVAL 1 MINUTE <= {_SETTLED}),
 gaps AS (SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER (PARTITION BY category, pattern ORDER BY timestamp) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS opens FROM due),
 stretch AS (SELECT *, sum(opens) OVER (PARTITION BY category, pattern ORDER BY timestamp) AS no FROM gaps),
 parts AS (SELECT category, pattern, no, service, count(*) AS n, min(timestamp) AS a, max(timestamp) AS b FROM stretch GROUP BY 1, 2, 3, 4),
 totals AS (SELECT category, pattern, CAST(sum(n) AS BIGINT) AS count, min(a) AS first_seen, max(b) AS last_seen, string_agg(service || '=' || n, ',' ORDER BY service) AS services FROM parts GROUP BY category, pattern, no),
 timed AS (SELECT *, last_seen + INTERVAL 24 HOUR >= {_SETTLED} AS live FROM totals),
 rated AS (SELECT *, CASE WHEN last_seen > first_seen THEN count / ((epoch_us(last_seen) - epoch_us(first_seen)) / 60e6) ELSE 0.0 END AS rate,
 CASE WHEN live THEN {_SETTLED} ELSE last_seen + INTERVAL 24 HOUR END AS until FROM timed)
 SELECT category, pattern, count, services, first_seen, last_seen, round(rate, 6) AS rate, live, CASE WHEN last_seen < until - INTERVAL 5 MINUTE THEN 'stable'
 WHEN rate > count / ((epoch_us(until) - epoch_us(first_seen)) / 60e6) * 1.2 THEN 'increasing' WHEN rate < count / ((epoch_us(until) - epoch_us(first_seen)) / 60e6) * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM rated""",
)
def stream_error_statistics(spark, sf_dir):
    """Statistics that end after 24 quiet hours, as they stand when the stream has been drained."""
    versions = j.run_available(live.error_statistics_stream(_shuffled_stream(spark, sf_dir), _LATE), "error-versions", state_machine=True)
    as_of = event_logs(spark, sf_dir).agg(F.max("timestamp")).first()[0] - timedelta(days=7)
    services = F.transform(F.array_sort(F.map_entries("services")), lambda r: F.concat_ws("=", r["key"], r["value"].cast("string")))
    stats = live.latest_statistics(versions, as_of).drop("current_rate")
    return stats.withColumns({"services": F.array_join(services, ","), "rate": F.round("rate", 6)})


@query(
    "stream_service_hourly",
    W + "SELECT date_trunc('hour', timestamp) AS hour, service, level, count(*) AS count, count(DISTINCT trace_id) AS unique_traces FROM logs GROUP BY 1, 2, 3",
)
def stream_service_hourly(spark, sf_dir):
    """The exact hourly rollup of logs that come in files out of order."""
    landing, path = scratch_path(spark, "hourly-landing"), scratch_path(spark, "hourly-rollup")
    sink = j.service_hourly_sink(_shuffled_stream(spark, sf_dir), landing, path, scratch_path(spark, "hourly-checkpoint"), trigger={"availableNow": True})
    sink.awaitTermination()
    return j.landed_service_hourly(spark, path)


@query(
    "stream_anomalies",
    f"""WITH {_HITS}, minutes AS (SELECT service, date_trunc('minute', timestamp) AS minute, count(DISTINCT id) AS errors FROM found GROUP BY 1, 2),
 scored AS (SELECT *, count(*) OVER w AS points, avg(errors) OVER w AS mean, stddev_samp(errors) OVER w AS std_dev FROM minutes WHERE minute + INTERVAL 1 MINUTE <= {_SETTLED}
 WINDOW w AS (PARTITION BY service ORDER BY minute ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
 SELECT service, minute, errors, round((errors - mean) / std_dev, 5) AS z_score FROM scored WHERE points >= 10 AND std_dev > 1e-9 AND abs((errors - mean) / std_dev) > 2""",
)
def stream_anomalies(spark, sf_dir):
    scores = j.run_available(live.anomaly_stream(_shuffled_stream(spark, sf_dir), _LATE), "scores", state_machine=True)
    return live.scored(scores).filter("is_anomaly").select("service", "minute", "errors", F.round("z_score", 5).alias("z_score"))


_PHRASES = ("timeout", "GET /api/items/", "operation: checkout", "Null")


def _tail_filters(i: int) -> list[dict[str, str]]:
    """The filters of client ``i``; the SQL counterpart states them by the same rule."""
    own = [("level", "!=", "debug"), ("user_id", "=", f"U{i}")]
    own = own if i % 5 else [("level", "equals", "ERROR"), ("user_id", "starts_with", f"u{i % 90}")]
    if i % 5 == 2:
        own = [("message", "contains", _PHRASES[i % 4]), ("user_id", "ends_with", str(i % 100)), ("service", "not_equals", "cache-service")]
    if i % 5 == 3:
        own = [("message", "contains", f"items/{i % 100}"), ("message", "not_contains", "completed user_id=u1"), ("service", "starts_with", "order")]
    return [{"field": f, "operator": o, "value": v} for f, o, v in own]


@query(
    "tail_clients",
    W
    + f"""SELECT 'c' || i AS client, logs.id AS log_id, level FROM logs, range(1000) AS r(i) WHERE CASE i % 5 WHEN 0 THEN lower(level) = 'error' AND starts_with(lower(a_user_id), 'u' || i % 90)
 WHEN 2 THEN contains(lower(message), lower(list_extract({list(_PHRASES)}, CAST(i % 4 + 1 AS INT)))) AND ends_with(lower(a_user_id), CAST(i % 100 AS VARCHAR)) AND service <> 'cache-service'
 WHEN 3 THEN contains(lower(message), 'items/' || i % 100) AND NOT contains(lower(message), 'completed user_id=u1') AND starts_with(service, 'order')
 ELSE lower(level) <> 'debug' AND lower(a_user_id) = 'u' || i END""",
)
def tail_clients(spark, sf_dir):
    """A thousand clients with filters of their own, all served by one pass over the stream."""
    path = scratch_path(spark, "tails")
    clients = {f"c{i}": _tail_filters(i) for i in range(1000)}
    tails.clients_sink(log_stream(spark, sf_dir), clients, path, scratch_path(spark, "tails-checkpoint"), trigger={"availableNow": True}).awaitTermination()
    return tails.delivered(spark, path).select("client", "log_id", "level")
