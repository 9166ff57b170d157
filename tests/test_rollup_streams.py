"""Rollups that are kept on a stream, and sketches that are united."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ridgelog.operators import rollups as m
from ridgelog.schema import LOG_SCHEMA
from ridgelog.session import scratch_path
from ridgelog.streaming import jobs as j


def _rows(frame):
    return sorted((tuple(r) for r in frame.select("hour", "service", "level", "count", "unique_traces").collect()), key=repr)


def _log(i, minutes, trace, service="api"):
    stamp = None if minutes is None else datetime(2024, 1, 5, 22) + timedelta(minutes=minutes)
    return {"id": f"l{i}", "timestamp": stamp, "level": "info", "service": service, "trace_id": trace}


def test_hourly_rollup_of_late_and_repeated_logs(spark, make_logs):
    source, landing, path, checkpoint = (scratch_path(spark, n) for n in ("hs-in", "hs-land", "hs-out", "hs-check"))
    files = [
        [_log(0, 5, "a"), _log(1, 6, "b"), _log(2, 130, "a")],
        [_log(3, 7, "b"), _log(4, 8, "c"), _log(5, None, "a")],  # late for the first hour, and one without a time
        [_log(0, 5, "a"), _log(6, 131, "a", "db"), _log(7, None, "z")],  # delivered again
        [_log(1, 6, "d", "web")],  # a corrected version
    ]

    def drain():
        stream = j.stream_files(spark, source, LOG_SCHEMA, files_per_trigger=1)
        j.service_hourly_sink(stream, landing, path, checkpoint, trigger={"availableNow": True}).awaitTermination()

    for rows in files:
        make_logs(rows).coalesce(1).write.mode("append").parquet(source)
        drain()
    latest = [_log(0, 5, "a"), _log(1, 6, "d", "web"), _log(2, 130, "a"), _log(3, 7, "b"), _log(4, 8, "c"), _log(5, None, "a"), _log(6, 131, "a", "db"), _log(7, None, "z")]
    assert _rows(j.landed_service_hourly(spark, path)) == _rows(m.service_hourly(make_logs(latest)))


def test_sketches_unite_to_days(spark):
    logs = spark.range(60_000).select(
        F.timestamp_seconds(F.lit(1704412800) + F.col("id") % 172_800).cast("timestamp_ntz").alias("timestamp"), F.lit("api").alias("service"), F.lit("info").alias("level"),
        (F.col("id") % 20_000).cast("string").alias("trace_id"), F.repeat(F.lit("x"), (F.col("id") % 1000).cast("int")).alias("message"),
    )
    hourly = m.sketch_rollup(logs)
    once = m.sketch_estimates(m.merge_sketches(hourly, "service")).first()
    days = m.merge_sketches(hourly, F.to_date("hour").alias("day"), "service")
    twice = m.sketch_estimates(m.merge_sketches(days, "service")).first()
    for row in (once, twice):
        assert row["count"] == 60_000
        assert abs(row["unique_traces"] - 20_000) <= 1000
        assert abs(row["p50"] - 500) <= 50 and abs(row["p95"] - 950) <= 50


def test_sketches_count_empty_and_null_traces_like_the_exact_rollup(spark, make_logs):
    logs = make_logs([{"trace_id": t, "message": "m", "service": "s"} for t in ("", "", "a", None)])
    assert m.sketch_estimates(m.sketch_rollup(logs)).first()["unique_traces"] == 2 == m.service_hourly(logs).first()["unique_traces"]
    assert m.sketch_estimates(m.sketch_rollup(logs.limit(0))).count() == 0


def test_replay_has_the_pages_of_the_polls(spark, make_logs):
    logs = make_logs([{"id": f"l{i:03d}", "timestamp": datetime(2024, 1, 5) + timedelta(seconds=i // 25)} for i in range(90)])
    since = datetime(2024, 1, 5)
    polls = [sorted(r["id"] for r in p.collect()) for p in j.tail_pages(logs, since, 20)]
    replay = j.tail_replay(logs, since, 20).groupBy("page").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("page").collect()
    assert [r["ids"] for r in replay] == polls and len(polls) == 4
    assert j.tail_replay(logs, datetime(2025, 1, 1)).count() == 0
