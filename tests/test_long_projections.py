"""Long projections are not generated into the one method of their stage, which the JVM would interpret."""

import re

from pyspark.sql import functions as F

from ridgelog.catalog.tables import derive_logs, table
from ridgelog.functions.scalars import apart
from ridgelog.operators import traces as t


def _stages_with(frame, word):
    """The plan lines that hold the word and belong to a stage of generated code."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if word in line and re.match(r"[\s:+-]*\*\(\d+\)", line)]


def test_operations_and_derived_logs_stand_apart(spark, make_logs):
    logs = make_logs([{"id": "a", "trace_id": "t", "span_id": "s", "message": "GET /x"}])
    rows = t._traced(logs).select("trace_id", t._head().alias("head"))
    assert rows.first()["head"]["operation"] == "GET /x"
    assert _stages_with(rows, "RLIKE") == []
    assert _stages_with(derive_logs(table(spark, "/root/testdata/sf0.001", "events")), "max_memory_bytes") == []


def test_apart_keeps_values(spark):
    rows = spark.range(3).select(apart(F.when(F.col("id") != 1, F.col("id"))).alias("v"))
    assert [r["v"] for r in rows.collect()] == [0, None, 2]
