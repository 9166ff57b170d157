"""Error statistics and anomalies on a stream: expiry, order, recovery."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgelog.operators import errors as e
from ridgelog.schema import LOG_SCHEMA
from ridgelog.session import scratch_path
from ridgelog.streaming import errors as live
from ridgelog.streaming import jobs as j

START = datetime(2024, 1, 5)


def arriving(spark, make_logs, batches):
    """One file for each batch of (hours after START, service)."""
    path = scratch_path(spark, "arriving")
    for k, batch in enumerate(batches):
        rows = [{"id": f"{k}-{i}", "timestamp": START + timedelta(hours=h), "level": "error", "service": s} for i, (h, s) in enumerate(batch)]
        make_logs(rows).coalesce(1).write.mode("append").parquet(path)
    return path


def stretches(frame):
    return sorted((r.pattern, r.first_seen, r.last_seen, r["count"], r.services, r.live) for r in frame.collect())


def test_quiet_patterns_end_and_start_anew(spark, make_logs):
    """24 hours apart still belong together, a second more does not; files come in the wrong order; timers free the state."""
    second = 1 / 3600
    batches = [[(1, "a"), (1, "b"), (0.5, "a")], [(25, "a")], [(24.5, "b"), (3, "a")], [(49 + second, "c")], [(120, "x")], [(121, "x")]]
    path = arriving(spark, make_logs, batches)
    logs = j.stream_files(spark, path, LOG_SCHEMA, files_per_trigger=1)
    versions = j.run_available(live.error_statistics_stream(logs, "30 hours"), "versions")
    at = lambda h: START + timedelta(hours=h)
    found = stretches(live.latest_statistics(versions, START + timedelta(hours=92)))
    assert found == [
        ("LogLevel", at(0.5), at(25), 6, {"a": 4, "b": 2}, False),
        ("LogLevel", at(49 + second), at(49 + second), 1, {"c": 1}, False),
    ]
    # the watermark stands at 91 h: the timer of the second stretch, due at 73 h, has ended it
    assert versions.filter("ended").count() == 2


def test_versions_go_on_after_a_restart(spark, make_logs):
    path, out, checkpoint = arriving(spark, make_logs, [[(0, "a")], [(5, "a")]]), scratch_path(spark, "versions"), scratch_path(spark, "versions-checkpoint")

    def drain():
        logs = j.stream_files(spark, path, LOG_SCHEMA, files_per_trigger=1)
        versions = live.error_statistics_stream(logs, "1 hour")
        versions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return stretches(live.latest_statistics(spark.read.parquet(out), START + timedelta(hours=6)))

    assert [r[3] for r in drain()] == [1]
    rows = [{"id": str(h), "timestamp": START + timedelta(hours=h), "level": "error", "service": "b"} for h in (6, 9)]
    make_logs(rows).coalesce(1).write.mode("append").parquet(path)
    assert drain() == [("LogLevel", START, START + timedelta(hours=6), 3, {"a": 2, "b": 1}, True)]


@pytest.mark.parametrize("history", [100, 12])
def test_scores_equal_the_batch(spark, make_logs, history):
    minutes = [(m, 1 + (m * m) % 7 + (40 if m % 29 == 0 else 0)) for m in range(60)]
    rows = [{"id": f"{m}-{i}", "timestamp": START + timedelta(minutes=m, seconds=i % 60), "level": "error", "service": f"s{m % 2}"} for m, n in minutes for i in range(n)]
    logs, path = make_logs(rows), scratch_path(spark, "arriving")
    for lo, hi in ((10, 20), (0, 10), (30, 40), (20, 30), (40, 60)):
        bounds = [START + timedelta(minutes=m) for m in (lo, hi)]
        logs.filter((F.col("timestamp") >= bounds[0]) & (F.col("timestamp") < bounds[1])).coalesce(1).write.mode("append").parquet(path)
    stream = j.stream_files(spark, path, LOG_SCHEMA, files_per_trigger=1)
    scores = live.scored(j.run_available(live.anomaly_stream(stream, "20 minutes", history=history), "scores"))
    batch = e.with_z_score(e.errors_per_minute(logs), "errors", ["service"], "minute", history=history).filter(F.col("minute") < START + timedelta(minutes=39))
    rounded = lambda df: sorted((r.service, r.minute, r.errors, r.points, round(r["mean"], 6), round(r.z_score or 0, 6), r.is_anomaly) for r in df.collect())
    assert rounded(scores) == rounded(batch) and any(r[-1] for r in rounded(scores))
