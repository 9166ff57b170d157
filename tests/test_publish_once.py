"""Landed rows are reduced once in a publish, however often they are looked at."""

from datetime import datetime

from pyspark.sql import functions as F

from ridgelog.session import scratch_path
from ridgelog.storage import table as t


def test_landed_rows_are_reduced_once(spark, make_logs, monkeypatch):
    landing, path = scratch_path(spark, "once-landing"), scratch_path(spark, "once-table")
    logs = make_logs([{"id": f"l{i}", "timestamp": datetime(2024, 1, 1 + i % 3), "message": "m"} for i in range(30)])
    t.write_logs(logs, landing)
    t.write_logs(logs.limit(10), path)
    seen, latest = spark.sparkContext.accumulator(0), t._latest_landed

    def counted(message):
        seen.add(1)
        return message

    count = F.udf(counted, "string").asNondeterministic()
    monkeypatch.setattr(t, "_latest_landed", lambda rows: latest(rows).withColumn("message", count("message")))
    t.publish_days(spark, landing, path, [datetime(2024, 1, d).date() for d in (1, 2, 3)])
    assert t.read_logs(spark, path).count() == 30
    assert seen.value == 30
