"""Tails of many clients against the predicate of each."""

import random
from datetime import datetime, timedelta

from ridgelog.operators.filters import tail_condition
from ridgelog.schema import LOG_SCHEMA
from ridgelog.session import scratch_path
from ridgelog.streaming import clients as c
from ridgelog.streaming import jobs as j

TEXTS = ["Error in A", "error", "", "timeout after 30s", "ÄÖ time", "a", "ab", "TIMEOUT", "x" * 300 + "needle"]
FILTERS = [[], [("level", "equals", "ERROR")], [("level", "!=", "error")], [("message", "contains", "time"), ("message", "not_contains", "after")], [("message", "contains", "")],
           [("message", "not_contains", "")], [("message", "like", "a")], [("user", "starts_with", "U1"), ("message", "ends_with", "needle")], [("user", "=", "")], [("message", "starts_with", "ä")],
           [("message", "contains", "e"), ("message", "contains", "ee"), ("user", "not_equals", "u1")], [("user", "=", "u1"), ("user", "=", "u2")], [("message", "ends_with", "a")], [("level", "equals", "Error"), ("level", "equals", "error")]]


def test_every_client_gets_its_logs(spark, make_logs):
    rnd = random.Random(1)
    logs = make_logs([{"id": f"l{i}", "timestamp": datetime(2024, 1, 5) + timedelta(seconds=i // 3), "level": rnd.choice(["error", "Error", "info"]), "message": rnd.choice(TEXTS), "attributes": {"user": rnd.choice(["u1", "U12", "u2"])} if i % 3 else {}} for i in range(60)])
    clients = {f"c{k}": [{"field": f, "operator": o, "value": v} for f, o, v in own] for k, own in enumerate(FILTERS)}
    expected = {(k, r.id) for k, own in clients.items() for r in logs.filter(tail_condition(own)).select("id").collect()}
    rows = c.deliveries(logs, c.client_index(clients)).collect()
    assert {(r.client, r.log_id) for r in rows} == expected and len(rows) == len(expected)
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "tails")
    for part in logs.randomSplit([1.0, 1.0], seed=3):
        part.coalesce(1).write.mode("append").parquet(path)
    c.clients_sink(j.stream_files(spark, path, LOG_SCHEMA, files_per_trigger=1), clients, out, out + "-checkpoint", trigger={"availableNow": True}).awaitTermination()
    served = c.delivered(spark, out).collect()
    assert {(r.client, r.log_id) for r in served} == expected and len(served) == len(expected)


def test_no_clients_and_no_logs(spark, make_logs):
    logs = make_logs([{}])
    assert c.deliveries(logs, c.client_index({})).count() == 0
    assert [r.client for r in c.deliveries(logs, c.client_index({"all": []})).collect()] == ["all"]
    assert c.deliveries(logs.limit(0), c.client_index({"all": [], "one": [{"field": "level", "operator": "=", "value": "x"}]})).count() == 0
