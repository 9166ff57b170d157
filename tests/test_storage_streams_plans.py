from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgelog.operators import errors as e
from ridgelog.operators import filters as f
from ridgelog.operators import parsing as p
from ridgelog.operators import rules as v
from ridgelog.operators import traces as t
from ridgelog.operators.pages import keyset_rows
from ridgelog.operators.query import QuerySpec, run_query
from ridgelog.plans import templates
from ridgelog.schema import LOG_SCHEMA
from ridgelog import session
from ridgelog.session import checkpointed, folder_system, release_scratch, scratch_path
from ridgelog.storage import export as x
from ridgelog.storage import stats, table
from ridgelog.streaming import jobs as j


@pytest.fixture
def month(make_logs):
    """Twelve days, one of which holds a third of the rows."""
    days = [datetime(2024, 1, 10) + timedelta(days=i // 3 % 12 if i % 3 else 5, minutes=i, microseconds=1234) for i in range(240)]
    return make_logs(
        [
            {"timestamp": d, "level": ("error", "info")[i % 2], "service": f"s{i % 4}", "trace_id": f"{i % 9:032x}", "span_id": f"sp{i % 5}",
             "message": f"request timeout {i}", "attributes": {"n": str(i)}}
            for i, d in enumerate(days)
        ]
    )


@pytest.fixture
def stored(spark, month):
    path = scratch_path(spark, "t")
    table.write_logs(month, path)
    return path


def test_written_table_keeps_every_row(spark, month, stored):
    rows = table.read_logs(spark, stored)
    assert rows.count() == 240
    assert rows.filter("level_numeric != case level when 'error' then 4 else 2 end or hour_partition != hour(timestamp)").count() == 0
    kept = {r.id: r.timestamp for r in rows.collect()}
    for r in month.collect():
        assert kept[r.id] == r.timestamp.replace(microsecond=r.timestamp.microsecond // 1000 * 1000)


def test_time_filter_prunes_partitions_and_pushes_down(spark, stored):
    rows = f.time_filter(table.read_logs(spark, stored), datetime(2024, 1, 12, 6), datetime(2024, 1, 13))
    plan = rows.filter("level = 'error'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_partition" in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "EqualTo(level,error)" in plan
    assert "message" not in plan.split("ReadSchema")[1]


def test_saved_queries_and_pages_read_only_the_days_they_need(spark, stored):
    logs = table.read_logs(spark, stored)
    now = datetime(2024, 1, 20)
    frames = [
        templates.errors_by_service(logs, now, hours=24),
        templates.levels_over_time(logs, now),
        templates.recent_errors(logs, now, "s1"),
        keyset_rows(logs, "timestamp", ("2024-01-12 00:00:00", "log-100"), 10),
        j.tail_batch(logs, now),
        run_query(logs, QuerySpec("q", filters=[f.Filter("timestamp", "greater_than", "2024-01-12 10:00:00")])),
        run_query(logs, QuerySpec("q", filters=[f.Filter("timestamp", "between", values=(now, now + timedelta(days=1)))])),
        table.retained(logs, datetime(2024, 2, 12)),
    ]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date_partition" in plan, plan


def test_or_filters_do_not_prune(spark, stored):
    logs = table.read_logs(spark, stored)
    spec = QuerySpec("q", filters=[f.Filter("timestamp", "less_than", "2024-01-12"), f.Filter("level", "equals", "error", logical_op="OR")])
    expected = logs.filter("timestamp < timestamp_ntz'2024-01-12' or level = 'error'").count()
    assert run_query(logs, spec).count() == expected > 0


def test_expiry_and_compaction(spark, month, stored, as_of):
    table.write_logs(month.withColumn("id", F.concat(F.lit("again-"), "id")), stored)
    before = stats.partition_info(stats.file_info(spark, stored))
    days = [r.date_partition for r in table.compaction_candidates(before, as_of).collect()]
    assert days == [date(2024, 1, 10) + timedelta(days=i) for i in range(10)]
    parts = {r.date_partition: r.parts for r in before.collect()}
    table.compact(spark, stored, days)
    after = {r.date_partition: (r.parts, r.rows) for r in stats.partition_info(stats.file_info(spark, stored)).collect()}
    assert sum(r for _, r in after.values()) == 480
    assert sum(after[d][0] for d in days) < sum(parts[d] for d in days)
    assert sorted(set(parts) - set(days)) == [d for d in sorted(parts) if after[d][0] == parts[d] and d not in days]
    dropped = table.drop_expired(spark, stored, datetime(2024, 2, 12))
    assert dropped == ["2024-01-10", "2024-01-11", "2024-01-12"]
    assert table.read_logs(spark, stored).agg(F.min("date_partition")).first()[0] == date(2024, 1, 13)


def test_statistics_and_advice(spark, stored):
    files = stats.file_info(spark, stored)
    row = stats.storage_statistics(files).first()
    assert (row.total_rows, row.partition_count, row.oldest_date) == (240, 12, date(2024, 1, 10))
    assert row.compressed_size.endswith(" KiB")
    assert stats.SMALL_PARTS in stats.storage_analysis(files).first().recommendations


def test_exports(spark, month, tmp_path):
    odd = month.limit(3).withColumn("message", F.lit('a "quoted", text\nwith  lines \\n'))
    path = str(tmp_path / "csv")
    x.export_csv(odd, path, ("id", "message", "n", "attributes"))
    rows = x.read_csv_export(spark, path, ("id", "message", "n", "attributes")).collect()
    assert {r.message for r in rows} == {'a "quoted", text\nwith  lines \\n'}
    assert all(r.attributes == f'{{"n":"{r.n}"}}' for r in rows)
    assert x.export_json(month, str(tmp_path / "json")) == 240
    assert spark.read.schema(LOG_SCHEMA).json(str(tmp_path / "json")).filter("attributes['n'] is null").count() == 0


def split_stream(spark, frame, parts):
    """The rows in time order, one file per micro-batch."""
    path = scratch_path(spark, "in")
    rows = frame.orderBy("timestamp").collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return j.stream_files(spark, path, LOG_SCHEMA, files_per_trigger=1)


def rows_of(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)


def test_stateless_streams_equal_batch(spark, month):
    stream = split_stream(spark, month, 5)
    wanted = [{"field": "service", "operator": "ends_with", "value": "1"}]
    assert rows_of(j.run_available(j.tail_stream(stream, wanted), "a")) == rows_of(j.tail_view(month.filter(f.tail_condition(wanted))))
    enriched = j.run_available(j.enrich(stream).drop("attributes"), "b")
    assert rows_of(enriched) == rows_of(j.enrich(month).drop("attributes"))
    parsed = j.run_available(p.parse_lines(stream.selectExpr("id", "message AS value"), as_of=datetime(2024, 1, 31)).drop("attributes"), "c")
    assert parsed.count() == 240 and parsed.filter("success").count() == 240
    assert j.run_available(v.validate(stream).select("id"), "d").count() == v.validate(month).count()


def test_stateful_streams_equal_batch_up_to_the_watermark(spark, month):
    stream = split_stream(spark, month, 6)
    newest = month.agg(F.max("timestamp")).first()[0] - timedelta(minutes=10)
    sessions = t.trace_sessions(month).filter(F.col("last_log") + F.expr("INTERVAL 1 HOUR") <= F.lit(str(newest)).cast("timestamp_ntz"))
    traces = j.run_available(j.trace_state(stream), "e")
    assert rows_of(traces.select(*sessions.columns)) == rows_of(sessions)
    services = {r.trace_id: (r.services, r.span_count) for r in traces.collect()}
    for r in month.groupBy("trace_id").agg(F.array_sort(F.collect_set("service")).alias("s"), F.count_distinct("span_id").alias("n")).collect():
        assert all(set(s) <= set(r.s) and n <= r.n for t, (s, n) in services.items() if t == r.trace_id)
    assert all(r.duration_ms == (r.last_log - r.first_log) // timedelta(milliseconds=1) for r in traces.collect())
    counts = j.run_available(j.error_state(stream, "1 day"), "f").groupBy("category", "pattern").agg(F.sum("count").alias("n"))
    closed = month.filter(F.col("timestamp") < F.lit(str(newest.date())).cast("timestamp_ntz"))
    expected = e.error_counts(closed).groupBy("category", "pattern").agg(F.sum("count").alias("n"))
    assert rows_of(counts) == rows_of(expected)


def test_duplicates_are_dropped_and_totals_are_not_counted_twice(spark, month):
    stream = split_stream(spark, month, 4)
    assert j.run_available(j.deduplicate(stream.union(stream), "30 days").select("id"), "g").count() == 240
    path = scratch_path(spark, "totals")
    hits = e.with_hits(stream, "timestamp").select("category", "pattern", F.lit(1).alias("count"), F.col("timestamp").alias("first_seen"))
    sink = j.totals_sink(hits, path, path + "-checkpoint", ["category", "pattern"], ["count"], ["first_seen"], trigger={"availableNow": True})
    sink.awaitTermination()
    totals = {(r.category, r.pattern): (r["count"], r.first_seen) for r in j.latest_totals(spark, path).collect()}
    first = month.agg(F.min("timestamp")).first()[0]
    assert totals[("network", "Timeout")] == (240, first) and totals[("error", "LogLevel")][0] == 120


def test_landing_to_published_table(spark, month):
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "published")
    j.append_sink(split_stream(spark, month, 3), landing, landing + "-checkpoint", trigger={"availableNow": True}).awaitTermination()
    days = [r[0] for r in table.read_logs(spark, landing).select("date_partition").distinct().collect()]
    for _ in range(2):
        table.publish_days(spark, landing, path, days)
    assert table.read_logs(spark, path).count() == 240


def test_late_logs_reach_the_table_and_repeated_ones_are_removed(spark, make_logs):
    """Batches of 12:00, 12:30 and 09:00, the first of which comes again."""
    source, landing, path = (scratch_path(spark, n) for n in ("arriving", "landing", "published"))
    logs = [{"id": f"{h}:{m}", "timestamp": datetime(2024, 1, 5, h, m)} for h, m in ((12, 0), (12, 30), (9, 0), (12, 0))]
    for log in logs:
        make_logs([log]).coalesce(1).write.mode("append").parquet(source)
    stream = j.stream_files(spark, source, LOG_SCHEMA, files_per_trigger=1)
    j.append_sink(stream, landing, landing + "-checkpoint", trigger={"availableNow": True}).awaitTermination()
    table.write_logs(make_logs([{"id": "stored", "timestamp": datetime(2024, 1, 5)}]), path)
    table.publish_days(spark, landing, path, [date(2024, 1, 5)])
    assert sorted(r.id for r in table.read_logs(spark, path).collect()) == ["12:0", "12:30", "9:0", "stored"]


@pytest.mark.parametrize("interval", ["daily", "hourly", "weekly", "monthly"])
def test_rows_without_a_time_and_moved_rows_are_published(spark, make_logs, interval):
    """Ids that lose their time, get one, or move to another partition stand once, in the version that landed."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "published")
    at = lambda month, day: datetime(2024, month, day, 3)
    untimed = make_logs([{"id": "none"}, {"id": "found"}]).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    stored = make_logs([{"id": "stays", "timestamp": at(1, 5)}, {"id": "moves", "timestamp": at(3, 9), "level": "old"}, {"id": "none", "timestamp": at(1, 5)}])
    table.write_logs(stored.unionByName(untimed.filter("id = 'found'")), path, interval=interval)
    landed = make_logs([{"id": "moves", "timestamp": at(1, 6), "level": "first"}, {"id": "found", "timestamp": at(1, 5)}])
    later = make_logs([{"id": "moves", "timestamp": at(1, 20), "level": "last"}])
    for rows in (landed, later, untimed.filter("id = 'none'")):
        table.write_logs(rows, landing)
    days = [r[0] for r in table.read_logs(spark, landing).select("date_partition").distinct().collect()]
    assert None in days
    for _ in range(2):
        table.publish_days(spark, landing, path, days)
        rows = {(r.id, r.timestamp, r.level) for r in table.read_logs(spark, path).collect()}
        assert rows == {("stays", at(1, 5), ""), ("moves", at(1, 20), "last"), ("found", at(1, 5), ""), ("none", None, "")}
        assert table.read_logs(spark, path).count() == 4
    table.publish_days(spark, landing, scratch_path(spark, "new"), days, interval=interval)


def test_rows_after_the_watermark_are_counted(spark, make_logs):
    source, out = scratch_path(spark, "arriving"), scratch_path(spark, "counts")
    for h in (12, 15, 9, 16, 17):
        make_logs([{"id": str(h), "timestamp": datetime(2024, 1, 5, h)}]).coalesce(1).write.mode("append").parquet(source)
    counts = j.window_counts(j.stream_files(spark, source, LOG_SCHEMA, files_per_trigger=1), ["level"])
    query = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert j.dropped_rows(query) == 1


@pytest.mark.parametrize("codec", sorted(table.PARQUET_CODEC))
def test_codec_is_the_one_asked_for(spark, month, codec):
    import pyarrow.parquet as pq

    path = scratch_path(spark, "codec")
    table.write_logs(month.limit(20), path, codec=codec)
    found = {pq.read_metadata(f.removeprefix("file:")).row_group(0).column(0).compression.lower() for f in spark.read.parquet(path).inputFiles()}
    assert found == {{"lz4_raw": "lz4", "none": "uncompressed"}.get(table.PARQUET_CODEC[codec], table.PARQUET_CODEC[codec])}


def test_files_are_sorted(spark, stored):
    rows = table.read_logs(spark, stored).select("_metadata.file_path", "_metadata.row_index", *table.SORT_ORDER).orderBy("file_path", "row_index").collect()
    for one, two in zip(rows, rows[1:]):
        assert one.file_path != two.file_path or tuple(one)[2:] <= tuple(two)[2:]


def test_polls_deliver_logs_of_one_time(spark, make_logs):
    logs = make_logs([{"id": f"log-{i:03d}", "timestamp": datetime(2024, 1, 5)} for i in range(150)] + [{"id": "z", "timestamp": datetime(2024, 1, 6)}])
    pages = [[r.id for r in p.collect()] for p in j.tail_pages(logs, datetime(2024, 1, 1), 100)]
    assert [len(p) for p in pages] == [100, 51] and sum(pages, []) == sorted(r.id for r in logs.collect())
    assert j.tail_batch(logs, datetime(2024, 1, 5), after_id="log-148").count() == 2


@pytest.mark.parametrize("interval, column", [("weekly", "week_partition"), ("monthly", "month_partition"), ("hourly", "date_partition")])
def test_jobs_follow_the_layout_of_the_table(spark, month, interval, column):
    path = scratch_path(spark, interval)
    lost = month.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz")).withColumn("id", F.lit("lost"))
    for rows in (month.filter("level = 'info'"), month.filter("level != 'info'"), lost):
        table.write_logs(rows, path, interval=interval)
    assert table.stored_interval(spark, path) == interval
    info = stats.partition_info(stats.file_info(spark, path, column), column)
    assert info.agg(F.sum("rows")).first()[0] == 241
    old = [r[0] for r in table.compaction_candidates(info, datetime(2024, 3, 31), limit=1).collect()]
    with pytest.raises(ValueError):
        table.compact(spark, path, old, interval="daily" if interval != "hourly" else "weekly")
    table.compact(spark, path, old)
    assert table.read_logs(spark, path).count() == 241
    early = f.time_filter(table.read_logs(spark, path), datetime(2024, 1, 12), datetime(2024, 1, 13))
    assert "PartitionFilters: [isnotnull(" + column in early._jdf.queryExecution().executedPlan().toString()
    assert early.count() == month.filter("timestamp between timestamp_ntz'2024-01-12' and timestamp_ntz'2024-01-13'").count()
    info = stats.partition_info(stats.file_info(spark, path, column), column)
    expired = [str(r[0]) for r in table.expired_days(info, datetime(2024, 2, 14)).collect()]
    assert table.drop_expired(spark, path, datetime(2024, 2, 14)) == sorted(expired)
    last = {"weekly": "2024-01-15", "monthly": "2024-01-01", "hourly": "2024-01-15"}[interval]
    assert table.read_logs(spark, path).count() == month.filter(f"timestamp >= timestamp_ntz'{last}'").count() + 1


def test_footers_equal_those_another_engine_reads(spark, stored):
    import duckdb

    rows = duckdb.sql(
        f"SELECT file_name, sum(total_compressed_size), sum(total_uncompressed_size) FROM parquet_metadata('{stored}/*/*.parquet') GROUP BY 1"
    ).fetchall()
    found = {r.file.removeprefix("file:"): (r.compressed, r.uncompressed) for r in stats.file_info(spark, stored).collect()}
    assert found == {name: (c, u) for name, c, u in rows}


def test_totals_keep_two_versions_and_ignore_half_written_ones(spark, month):
    path = scratch_path(spark, "versions")
    hits = e.with_hits(split_stream(spark, month, 4), "timestamp").select("category", F.lit(1).alias("count"))
    j.totals_sink(hits, path, path + "-checkpoint", ["category"], ["count"], trigger={"availableNow": True}).awaitTermination()
    assert len(j._versions(spark, path)) == 2
    before = rows_of(j.latest_totals(spark, path))
    spark.range(3).write.parquet(f"{path}/version=99")
    system, mark = folder_system(spark, f"{path}/version=99/_SUCCESS")
    system.delete(mark, False)
    assert rows_of(j.latest_totals(spark, path)) == before


def test_scratch_folders_are_released(spark, month):
    # other tests go on with theirs
    own = spark.sparkContext.applicationId
    others, session._SCRATCH[own] = session._SCRATCH.get(own, []), []
    path = checkpointed(month.drop("attributes")).inputFiles()[0].rsplit("/", 1)[0]
    assert release_scratch(spark) == 1
    system, root = folder_system(spark, path)
    assert not system.exists(root) and release_scratch(spark) == 0
    session._SCRATCH[own] = others


def test_plans_stay_in_the_jvm_without_cross_joins(spark, stored, as_of):
    logs = table.read_logs(spark, stored).select(*LOG_SCHEMA.fieldNames())
    frames = [
        t.timeline(logs),
        t.trace_sessions(logs),
        e.error_statistics(e.error_counts(logs), as_of),
        e.anomalies(logs),
        e.error_samples(logs),
        v.transform(logs),
        p.parse_stored_messages(logs, as_of=as_of),
    ]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
            assert word not in plan, (word, plan)
    samples = e.error_samples(logs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in samples


def test_checkpointed_reads_a_written_table(month):
    assert rows_of(checkpointed(month.drop("attributes"))) == rows_of(month.drop("attributes"))
