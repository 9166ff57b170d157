"""Table layout, retention, compaction, statistics, exports."""

from datetime import datetime

from pyspark.sql import functions as F

from ridgelog.catalog.registry import query
from ridgelog.catalog.tables import AS_OF, LOGS, event_logs, logs_path, stored_logs, table
from ridgelog.functions.scalars import attr, ntz
from ridgelog.session import scratch_path
from ridgelog.storage import export as x
from ridgelog.storage import stats
from ridgelog.storage import table as t

_DAY = "strftime(timestamp, '%Y-%m-%d')"
W = "WITH " + LOGS + " "


def _day(column="date_partition"):
    return F.col(column).cast("string").alias("day")


@query(
    "stored_layout",
    W
    + f"""SELECT {_DAY} AS day, CAST(hour(timestamp) AS INT) AS hour_partition, CASE level WHEN 'debug' THEN 1 WHEN 'info' THEN 2 WHEN 'warn' THEN 3
 WHEN 'error' THEN 4 WHEN 'fatal' THEN 5 ELSE 0 END AS level_numeric, count(*) AS row_count FROM logs GROUP BY 1, 2, 3""",
)
def stored_layout(spark, sf_dir):
    rows = stored_logs(spark, sf_dir)
    return rows.groupBy(_day(), "hour_partition", "level_numeric").agg(F.count(F.lit(1)).alias("row_count"))


@query("hour_and_day_columns", W + f"SELECT id, date_trunc('hour', timestamp) AS hour, {_DAY} AS day FROM logs")
def hour_and_day_columns(spark, sf_dir):
    rows = t.with_hour_and_day(event_logs(spark, sf_dir))
    return rows.select("id", "hour", F.col("day").cast("string").alias("day"))


def _rewritten(spark, sf_dir, **layout):
    path = scratch_path(spark, "layout")
    t.write_logs(event_logs(spark, sf_dir).drop("date_partition"), path, **layout)
    return t.read_logs(spark, path)


def _period(column):
    return F.col(column).cast("string").alias("period")


@query("weekly_table", W + "SELECT strftime(timestamp, '%G%V') AS period, count(*) AS row_count, count(DISTINCT id) AS ids FROM logs GROUP BY 1")
def weekly_table(spark, sf_dir):
    rows = _rewritten(spark, sf_dir, interval="weekly", codec="LZ4")
    return rows.groupBy(_period("week_partition")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("id").alias("ids")
    )


@query("monthly_table", W + "SELECT strftime(timestamp, '%Y%m') AS period, count(*) AS row_count, count(NULLIF(a_user_id, '')) AS users FROM logs GROUP BY 1")
def monthly_table(spark, sf_dir):
    rows = _rewritten(spark, sf_dir, interval="monthly", codec="SNAPPY", cluster=True)
    return rows.groupBy(_period("month_partition")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count(F.col("attributes")["user_id"]).alias("users")
    )


@query("hourly_table", W + f"SELECT {_DAY} AS day, CAST(hour(timestamp) AS INT) AS hour, count(*) AS row_count FROM logs GROUP BY 1, 2")
def hourly_table(spark, sf_dir):
    rows = _rewritten(spark, sf_dir, interval="hourly", codec="ZSTD", level=5)
    return rows.groupBy(_day(), F.col("hour_partition").alias("hour")).agg(F.count(F.lit(1)).alias("row_count"))


@query("partition_pruned_count", W + "SELECT count(*) AS row_count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-10 06:00:00' AND timestamp <= TIMESTAMP '2024-01-12 18:00:00'")
def partition_pruned_count(spark, sf_dir):
    from ridgelog.operators.filters import time_filter

    rows = time_filter(stored_logs(spark, sf_dir), datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18))
    return rows.agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "retention_tiers",
    W
    + f"""SELECT {_DAY} AS day, CASE WHEN timestamp <= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY THEN 'expired' WHEN timestamp <= TIMESTAMP '2024-02-10' - INTERVAL 7 DAY
 THEN 'cold' ELSE 'hot' END AS tier, count(*) AS row_count FROM logs GROUP BY 1, 2""",
)
def retention_tiers(spark, sf_dir):
    return t.tier_counts(event_logs(spark, sf_dir), datetime(2024, 2, 10)).withColumn("day", F.col("day").cast("string"))


@query("retained_rows", W + "SELECT id, timestamp FROM logs WHERE timestamp > TIMESTAMP '2024-02-10' - INTERVAL 30 DAY")
def retained_rows(spark, sf_dir):
    return t.retained(event_logs(spark, sf_dir), datetime(2024, 2, 10)).select("id", "timestamp")


@query("drop_expired", W + f"SELECT {_DAY} AS day, count(*) AS row_count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-11' GROUP BY 1")
def drop_expired(spark, sf_dir):
    """Whole expired days are deleted from a copy of the table."""
    path = scratch_path(spark, "expiring")
    t.write_logs(event_logs(spark, sf_dir).drop("date_partition"), path)
    t.drop_expired(spark, path, datetime(2024, 2, 10))
    return t.read_logs(spark, path).groupBy(_day()).agg(F.count(F.lit(1)).alias("row_count"))


@query("expired_partitions", W + f"SELECT {_DAY} AS day, count(*) AS row_count FROM logs WHERE timestamp < TIMESTAMP '2024-01-11' GROUP BY 1")
def expired_partitions(spark, sf_dir):
    info = stats.partition_info(stats.file_info(spark, logs_path(spark, sf_dir)))
    return t.expired_days(info, datetime(2024, 2, 10)).select(_day(), F.col("rows").alias("row_count"))


@query(
    "compaction",
    W + f"SELECT {_DAY} AS day, count(*) AS row_count, min(id) AS first_id, max(id) AS last_id, {_DAY} > '2024-01-10' AS scattered FROM logs GROUP BY 1",
)
def compaction(spark, sf_dir):
    """Days written in two appends; the ten oldest ones are rewritten, the others stay scattered."""
    path = scratch_path(spark, "compacting")
    logs = event_logs(spark, sf_dir).drop("date_partition")
    noon = F.hour("timestamp") < 12
    for half in (noon, ~noon):
        t.write_logs(logs.filter(half), path)
    before = stats.partition_info(stats.file_info(spark, path))
    old = t.compaction_candidates(before, AS_OF)
    written = before.agg(F.max("last_modified")).first()[0]
    t.compact(spark, path, [r.date_partition for r in old.collect()])
    after = stats.partition_info(stats.file_info(spark, path))
    scattered = after.select("date_partition", (F.col("last_modified") <= F.lit(written)).alias("scattered"))
    rows = t.read_logs(spark, path).groupBy("date_partition").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
    return rows.join(scattered, "date_partition").select(_day(), "row_count", "first_id", "last_id", "scattered")


def _scattered(spark, sf_dir, interval):
    """A table whose partitions were written in two appends."""
    path = scratch_path(spark, interval)
    logs = event_logs(spark, sf_dir).drop("date_partition")
    for half in (F.hour("timestamp") < 12, F.hour("timestamp") >= 12):
        t.write_logs(logs.filter(half), path, interval=interval)
    return path


def _compacted(spark, sf_dir, interval):
    """All partitions past the hot window rewritten; rows, ids and files by partition."""
    path, (column, *_) = _scattered(spark, sf_dir, interval), t.PARTITIONS[interval]
    info = stats.partition_info(stats.file_info(spark, path, column), column)
    t.compact(spark, path, [r[0] for r in t.compaction_candidates(info, AS_OF).collect()])
    files = stats.partition_info(stats.file_info(spark, path, column), column).select(_period(column), F.col("rows").alias("footer_rows"))
    rows = t.read_logs(spark, path).groupBy(_period(column)).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("id").alias("ids"))
    return rows.join(files, "period")


_BY_PERIOD = "SELECT strftime(timestamp, '{}') AS period, count(*) AS row_count, count(DISTINCT id) AS ids, count(*) AS footer_rows FROM logs GROUP BY 1"


@query("weekly_compaction", W + _BY_PERIOD.format("%G%V"))
def weekly_compaction(spark, sf_dir):
    return _compacted(spark, sf_dir, "weekly")


@query("monthly_compaction", W + _BY_PERIOD.format("%Y%m"))
def monthly_compaction(spark, sf_dir):
    return _compacted(spark, sf_dir, "monthly")


@query("partition_info_monthly", W + "SELECT strftime(timestamp, '%Y%m') AS period, count(*) AS row_count FROM logs GROUP BY 1")
def partition_info_monthly(spark, sf_dir):
    info = stats.file_info(spark, _scattered(spark, sf_dir, "monthly"), "month_partition")
    return stats.partition_info(info, "month_partition").select(_period("month_partition"), F.col("rows").alias("row_count"))


@query(
    "drop_expired_weekly",
    W + "SELECT strftime(timestamp, '%G%V') AS period, count(*) AS row_count FROM logs WHERE date_trunc('week', timestamp) + INTERVAL 6 DAY >= TIMESTAMP '2024-01-11' GROUP BY 1",
)
def drop_expired_weekly(spark, sf_dir):
    """Weeks whose last day has expired are deleted; rows without a timestamp are in the table and stay out of the way."""
    path = scratch_path(spark, "expiring-weeks")
    logs = event_logs(spark, sf_dir).drop("date_partition")
    lost = logs.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    t.write_logs(logs.unionByName(lost), path, interval="weekly")
    t.drop_expired(spark, path, datetime(2024, 2, 10))
    kept = t.read_logs(spark, path).filter(F.col("timestamp").isNotNull())
    return kept.groupBy(_period("week_partition")).agg(F.count(F.lit(1)).alias("row_count"))


_MOVED = "CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN timestamp + INTERVAL 40 DAY ELSE timestamp END"


@query("publish_merge", W + f"SELECT strftime({_MOVED}, '%Y-%m-%d') AS day, count(*) AS row_count, count(DISTINCT id) AS ids, min(level) AS first_level FROM logs GROUP BY 1")
def publish_merge(spark, sf_dir):
    """Half of the logs are stored, all of them land twice, some with no time or 40 days later, and all that landed is published twice."""
    landing, path = scratch_path(spark, "landed"), scratch_path(spark, "merged")
    logs, number = event_logs(spark, sf_dir).drop("date_partition"), F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint")
    t.write_logs(logs.filter(F.hour("timestamp") < 12), path)
    late = logs.filter((F.hour("timestamp") >= 12) | (F.dayofmonth("timestamp") % 2 == 0) | (number % 83 == 0) | (number % 89 == 0))
    moved = F.when(number % 89 == 0, F.lit(None)).when(number % 83 == 0, F.col("timestamp") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("timestamp"))
    for _ in range(2):
        t.write_logs(late.withColumn("timestamp", moved), landing)
    days = [r[0] for r in t.read_logs(spark, landing).select("date_partition").distinct().collect()]
    for _ in range(2):
        t.publish_days(spark, landing, path, days)
    return t.read_logs(spark, path).groupBy(_day()).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("id").alias("ids"), F.min("level").alias("first_level")
    )


@query("partition_info", W + f"SELECT {_DAY} AS day, count(*) AS row_count, true AS has_bytes, true AS has_parts FROM logs GROUP BY 1")
def partition_info(spark, sf_dir):
    info = stats.partition_info(stats.file_info(spark, logs_path(spark, sf_dir)))
    return info.select(
        _day(), F.col("rows").alias("row_count"), (F.col("bytes") > 0).alias("has_bytes"), (F.col("parts") >= 1).alias("has_parts")
    )


def _footers(spark, sf_dir):
    return stats.file_info(spark, logs_path(spark, sf_dir))


@query(
    "storage_statistics",
    W
    + f"""SELECT count(*) AS total_rows, count(DISTINCT {_DAY}) AS partition_count, min({_DAY}) AS oldest_date, max({_DAY}) AS newest_date, true AS compressed FROM logs""",
)
def storage_statistics(spark, sf_dir):
    row = stats.storage_statistics(_footers(spark, sf_dir))
    return row.select(
        "total_rows",
        "partition_count",
        F.col("oldest_date").cast("string").alias("oldest_date"),
        F.col("newest_date").cast("string").alias("newest_date"),
        (F.col("compression_ratio") > 0).alias("compressed"),
    )


@query("storage_analysis", W + f"SELECT count(*) AS total_rows, true AS has_bytes, '{stats.SMALL_PARTS}' AS advice FROM logs")
def storage_analysis(spark, sf_dir):
    row = stats.storage_analysis(_footers(spark, sf_dir))
    advice = F.array_join(F.filter("recommendations", lambda r: r != stats.USE_ZSTD), "; ")
    return row.select("total_rows", (F.col("total_bytes") > 0).alias("has_bytes"), advice.alias("advice"))


@query(
    "storage_advice_by_order",
    f"""WITH v AS (SELECT o_orderkey, o_totalprice / 100000 AS ratio, CAST(o_totalprice * 10000000 AS BIGINT) AS bytes, 1 + o_custkey AS parts FROM orders)
 SELECT o_orderkey, array_to_string(list_filter([CASE WHEN ratio < 2 THEN '{stats.USE_ZSTD}' END, CASE WHEN bytes // parts < 104857600 THEN '{stats.SMALL_PARTS}' END,
 CASE WHEN bytes > 1099511627776 THEN '{stats.ARCHIVE}' END], lambda s: s IS NOT NULL), '; ') AS advice FROM v""",
)
def storage_advice_by_order(spark, sf_dir):
    """The recommendations over many sizes and ratios."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 100000).alias("ratio"),
        F.round(F.col("o_totalprice") * 10000000).cast("bigint").alias("bytes"),
        (F.col("o_custkey") + 1).alias("parts"),
    )
    return rows.select("o_orderkey", F.array_join(stats.recommendations("ratio", "bytes", "parts"), "; ").alias("advice"))


_EXPORT_FIELDS = ("id", "timestamp", "level", "message", "user_id", "no_such_field", "attributes")


@query(
    "export_csv",
    W
    + """SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, level, message, a_user_id AS user_id, '' AS no_such_field, a_exception AS exception FROM logs""",
)
def export_csv(spark, sf_dir):
    path = scratch_path(spark, "export-csv")
    x.export_csv(event_logs(spark, sf_dir), path, _EXPORT_FIELDS)
    rows = x.read_csv_export(spark, path, _EXPORT_FIELDS)
    text = {c: F.coalesce(c, F.lit("")) for c in ("message", "user_id", "no_such_field")}
    exception = F.coalesce(F.get_json_object("attributes", "$.exception"), F.lit(""))
    return rows.withColumns({**text, "exception": exception}).drop("attributes")


@query("export_csv_documents", "SELECT 'doc-' || doc_id AS id, source AS service, text AS message FROM documents")
def export_csv_documents(spark, sf_dir):
    """Long texts with line breaks and quotes survive the round trip."""
    from ridgelog.catalog.tables import document_logs

    path = scratch_path(spark, "export-documents")
    x.export_csv(document_logs(spark, sf_dir), path, ("id", "service", "message"))
    return x.read_csv_export(spark, path, ("id", "service", "message"))


@query("export_json", W + "SELECT id, timestamp, level, service, message, trace_id, span_id, a_user_id AS user_id, (SELECT count(*) FROM logs) AS exported FROM logs")
def export_json(spark, sf_dir):
    path = scratch_path(spark, "export-json")
    count = x.export_json(event_logs(spark, sf_dir).drop("date_partition"), path)
    schema = event_logs(spark, sf_dir).drop("date_partition").schema
    rows = spark.read.schema(schema).json(path)
    return rows.select(
        "id", "timestamp", "level", "service", "message", "trace_id", "span_id", attr("user_id").alias("user_id"), F.lit(count).cast("bigint").alias("exported")
    )


@query("export_parquet", W + "SELECT id, level, a_error AS error FROM logs WHERE timestamp >= TIMESTAMP '2024-01-16'")
def export_parquet(spark, sf_dir):
    path = scratch_path(spark, "export-parquet")
    x.export_parquet(event_logs(spark, sf_dir).filter(F.col("timestamp") >= ntz(datetime(2024, 1, 16))), path)
    return spark.read.parquet(path).select("id", "level", attr("error").alias("error"))
