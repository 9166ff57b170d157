import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from ridgelog.functions import scalars as x
from ridgelog.operators import aggregates as a
from ridgelog.operators import alerts as al
from ridgelog.operators import charts as d
from ridgelog.operators import filters as f
from ridgelog.operators import metrics as k
from ridgelog.operators import pages as p
from ridgelog.operators import rollups as m
from ridgelog.operators.query import Aggregation, OrderBy, QuerySpec, run_query, validate_spec
from ridgelog.plans.sql import run_sql
from ridgelog.plans.widgets import Widget, widget_data
from ridgelog.session import scratch_path
from ridgelog.streaming import jobs as j


@pytest.fixture
def logs(make_logs):
    rng = random.Random(3)
    levels, services = ("debug", "info", "warn", "error"), ("api", "db", "cache")
    return make_logs(
        [
            {
                "level": rng.choice(levels),
                "service": rng.choice(services),
                "message": f"Message {i % 7} 100%",
                "timestamp": datetime(2024, 1, 30, 12) + timedelta(seconds=rng.randint(0, 40)),
            }
            for i in range(60)
        ]
    )


def test_spec_is_checked(spark):
    for bad in (
        QuerySpec(""),
        QuerySpec("q", fields=("raw_log",)),
        QuerySpec("q", filters=[f.Filter("level", "like", "x")]),
        QuerySpec("q", filters=[f.Filter("nope", "equals", "x")]),
        QuerySpec("q", aggregations=(Aggregation("MEDIAN", "level"),)),
        QuerySpec("q", aggregations=(Aggregation("SUM", "nope"),)),
    ):
        with pytest.raises(ValueError):
            validate_spec(bad)
    for broken in (f.Filter("level", "between", values=(1,)), f.Filter("level", "in"), f.Filter("level", "soundslike")):
        with pytest.raises(ValueError):
            f.condition(broken)
    with pytest.raises(ValueError):
        f.TimeRange(relative="last_2y").bounds(datetime(2024, 1, 1))


def test_and_binds_tighter_than_or_and_time_covers_all(logs, as_of):
    filters = [
        f.Filter("level", "equals", "error"),
        f.Filter("service", "equals", "api", logical_op=""),
        f.Filter("level", "equals", "warn", logical_op="OR"),
    ]
    window = f.TimeRange(end=datetime(2024, 1, 30, 12, 0, 20))
    rows = run_query(logs, QuerySpec("q", filters=filters, time_range=window), as_of).collect()
    expected = [
        r
        for r in logs.collect()
        if r.timestamp <= window.end and ((r.level == "error" and r.service == "api") or r.level == "warn")
    ]
    assert sorted(r.id for r in rows) == sorted(r.id for r in expected) and expected


def test_default_alias_and_approximate_count(logs):
    spec = QuerySpec("q", aggregations=(Aggregation("MAX", "level"), Aggregation("COUNT_DISTINCT", "service", "n", approximate=True)))
    row = run_query(logs, spec).first()
    assert row.max_level == "warn" and row.n == 3


def test_offset_pages_concatenate_to_the_sorted_input(logs):
    expected = [r.id for r in logs.orderBy(F.desc("timestamp"), F.desc("id")).collect()]
    got, token, pages = [], "", []
    while True:
        page = p.offset_page(logs, p.PageRequest(page_size=17, page_token=token, sort_by="timestamp"))
        pages.append(page)
        got += [r.id for r in page.rows]
        token = page.next_page_token
        if not page.has_more:
            break
    assert got == expected and len(pages) == 4
    assert p.decode_token(pages[2].prev_page_token)["offset"] == 17 and pages[0].prev_page_token == ""


@pytest.mark.parametrize("order", ["ASC", "DESC"])
def test_keyset_pages_lose_no_ties(logs, order):
    by = [F.asc("timestamp"), F.asc("id")] if order == "ASC" else [F.desc("timestamp"), F.desc("id")]
    expected = [r.id for r in logs.orderBy(*by).collect()]
    got, token = [], ""
    while True:
        page = p.keyset_page(logs, "timestamp", p.PageRequest(page_size=7, page_token=token, sort_order=order))
        got += [r.id for r in page.rows]
        token = page.next_page_token
        if not page.has_more:
            break
    assert got == expected


def test_page_requests_are_normalised():
    assert p.normalise(p.PageRequest()).page_size == 100
    assert p.normalise(p.PageRequest(page_size=5000, sort_order="asc")) == p.PageRequest(1000, "", "", "ASC")
    for bad in (p.PageRequest(sort_order="up"), p.PageRequest(page_token="?")):
        with pytest.raises(ValueError):
            p.normalise(bad)


def test_sql_is_bound_and_read_only(logs):
    rows = run_sql(logs, "SELECT count(*) AS n FROM logs WHERE level = ${level} LIMIT :k", {"level": "x' OR '1'='1", "k": 5})
    assert rows.first().n == 0
    with pytest.raises(ValueError):
        run_sql(logs, "DROP TABLE logs")
    for hidden in ("WITH x AS (SELECT 1) INSERT OVERWRITE DIRECTORY '/tmp/no' USING parquet SELECT * FROM x", "SELECT 1; DROP VIEW logs", "SELECT 1) UNION ALL (SELECT 2"):
        with pytest.raises((ValueError, ParseException)):
            run_sql(logs, hidden)
    assert run_sql(logs, "WITH x AS (SELECT id FROM logs) SELECT * FROM x ORDER BY id DESC LIMIT 2;", max_rows=1).count() == 1
    assert run_sql(logs, "SELECT id FROM logs", max_rows=4).count() == 4


def test_unknown_tail_operator_matches_nothing(logs):
    assert logs.filter(f.tail_condition([{"field": "level", "operator": "regex", "value": "."}])).count() == 0
    assert logs.filter(f.tail_condition([])).count() == 60


def test_merge_keeps_first_value_and_skips_unreadable(spark):
    one = spark.createDataFrame([("a", 1, 2.5, None), ("b", 2, 1.0, "x")], "k string, n int, v double, t string")
    two = spark.createDataFrame([("a", 10, 0.5, "late"), ("c", 5, 1.0, "z")], "k string, n int, v double, t string")
    merged = a.merge_partials([one, two, lambda: spark.read.parquet("/no/such/table")], ["k"])
    assert {r.k: (r.n, r.v, r.t) for r in merged.collect()} == {"a": (11, 3.0, "late"), "b": (2, 1.0, "x"), "c": (5, 1.0, "z")}


def test_shard_counts_place_equal_keys_together(spark):
    rows = spark.createDataFrame([(f"k{i % 40}",) for i in range(400)] + [(None,)], "k string")
    counts = a.shard_counts(rows, "k", 8).collect()
    assert sum(r.row_count for r in counts) == 401 and sum(r["keys"] for r in counts) == 41
    assert {r.shard for r in counts if r.shard is not None} <= set(range(8))


def test_display_functions(spark):
    sizes = {0.0: "0.00 B", 1023.0: "1023.00 B", 1536.0: "1.50 KiB", 5.0 * 1024**3: "5.00 GiB"}
    shorts = {999.0: "999", 12.3456: "12.346", 1250.0: "1.3K", 3400000.0: "3.4M", 0.5: "0.5", 100.0: "100"}
    for table, fn in ((sizes, x.readable_size), (shorts, x.short_number)):
        rows = spark.createDataFrame([(v,) for v in table], "v double").select("v", fn("v").alias("t")).collect()
        assert {r.v: r.t for r in rows} == table


def test_rollup_of_rollups_equals_rollup(logs):
    halves = [m.errors_daily(logs.filter(c)) for c in (F.col("service") == "api", F.col("service") != "api")]
    merged = m.merge_rollups(*halves, ["day", "service"], ["error_count", "warn_count", "total_count"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, m.errors_daily(logs).collect()))


def test_histogram_counts_and_percentiles(spark):
    values = [0.05, 0.1, 0.3, 1, 1, 7, 60, 2000, 3000]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    buckets = {r.bucket: r["count"] for r in k.histogram(frame, "v").collect()}
    assert buckets == {0: 2, 1: 1, 2: 2, 4: 1, 6: 1, 9: 2} and sum(buckets.values()) == len(values)
    row = k.histogram_stats(frame, "v").first()
    assert (row.p50, row.p90, row.p99, row.max) == (1.0, 3000.0, 3000.0, 3000.0)
    empty = k.histogram_stats(frame.limit(0), "v").first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_sliding_rate_against_brute_force(spark):
    rng = random.Random(5)
    base = datetime(2024, 1, 1)
    times = sorted(base + timedelta(milliseconds=rng.randint(0, 400_000)) for _ in range(300))
    frame = spark.createDataFrame([(t,) for t in times], "timestamp timestamp_ntz")
    for row in k.sliding_rate(frame).collect():
        inside = [t for t in times if row.second - timedelta(seconds=59) <= t.replace(microsecond=0) <= row.second]
        assert abs(row.rate - len(inside) / 60) < 1e-9


def test_counter_reset_and_holding_condition(spark):
    series = spark.createDataFrame([("c", 0, 5.0), ("c", 60, 8.0), ("c", 120, 2.0), ("c", 180, 4.0)], "k string, at bigint, value double")
    rows = k.counter_increase(series, ["k"], 121).orderBy("at").collect()
    assert [r.increase for r in rows] == [0.0, 3.0, 5.0, 7.0]
    held = k.holds_for(series, ["k"], F.col("value") > 3, 60).orderBy("at").collect()
    assert [r.firing for r in held] == [False, True, False, False]


def walk(checks, cooldown):
    found, current, last = [], None, None
    for at, on in checks:
        if last is not None and at - last < cooldown:
            continue
        if on:
            if current is None:
                current = {"start": at, "last": at, "end": None, "count": 0}
                found.append(current)
            current["last"], current["count"], last = at, current["count"] + 1, at
        elif current is not None:
            current["end"] = current["last"] = at
            current = None
    return sorted((c["start"], c["last"], c["end"], c["count"]) for c in found)


@pytest.mark.parametrize("cooldown", [0, 60, 150, 600])
def test_alert_cooldown_against_brute_force(spark, cooldown):
    rng = random.Random(cooldown)
    checks, at = [], 0
    for _ in range(200):
        at += rng.choice((30, 60, 60, 400))
        checks.append((at, rng.random() < 0.35))
    frame = spark.createDataFrame([("r", "info", cooldown, t, on) for t, on in checks], "rule string, severity string, cooldown int, at bigint, triggered boolean")
    got = sorted((r.start_at, r.last_at, r.end_at, r["count"]) for r in al.episodes_with_cooldown(frame).collect())
    assert got == walk(checks, cooldown)
    cut = sorted((r.start_at, r.last_at, r.end_at, r["count"]) for r in al.episodes_by_blocks(frame, 700).collect())
    assert cut == got
    # the checks come in four files, the latest first; the last file carries the watermark past all of them
    path, rows = scratch_path(spark, "checks"), frame.collect()
    for part in ([r for r in rows[150:]], rows[0:100:2], rows[1:100:2], rows[100:150], [("mark", "info", cooldown, 10_000_000, False)]):
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(path)
    stream = j.stream_files(spark, path, frame.schema, files_per_trigger=1)
    versions = j.run_available(al.episode_stream(stream, "2 days"), "alerts").where("rule = 'r'")
    assert sorted((r.start_at, r.last_at, r.end_at, r["count"]) for r in al.latest_episodes(versions).collect()) == got
    if cooldown == 0:
        plain = sorted((r.start_at, r.end_at, r["count"]) for r in al.episodes(frame).collect())
        assert plain == [(s, e, c) for s, _, e, c in got]


def test_alert_blocks_spread_a_rule(spark, monkeypatch):
    """Three rules, one of which holds nearly all checks and is quiet for a year; no group or window is by rule alone."""
    rng = random.Random(5)
    rows = [("a", 300, t, rng.random() < 0.3) for t in range(0, 400_000, 100)] + [("a", 300, 40_000_000 + t, t < 5000) for t in range(0, 9000, 100)]
    rows += [("b", 0, 7, True), ("c", 100_000, 5, True), ("c", 100_000, 200_000, True), ("c", 100_000, 200_001, False), ("c", 100_000, 900_000, False)]
    frame = spark.createDataFrame([(r, "info", c, t, on) for r, c, t, on in rows], "rule string, severity string, cooldown int, at bigint, triggered boolean")
    listed = lambda df: sorted(((r.rule, r.start_at, r.last_at, r.end_at, r["count"]) for r in df.collect()), key=repr)
    whole = listed(al.episodes_with_cooldown(frame))
    expected = [(rule, *e) for rule in "abc" for e in walk(sorted((t, on) for r, _, t, on in rows if r == rule), {"a": 300, "b": 0, "c": 100_000}[rule])]
    assert whole == sorted(expected, key=repr)
    plans = []
    kept = al.episodes_by_blocks.__globals__["climbed"]
    monkeypatch.setitem(al.episodes_by_blocks.__globals__, "climbed", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, label))
    assert listed(al.episodes_with_cooldown(frame, walk_most=100)) == whole
    plan = "\n".join(plans)
    assert "FlatMapGroupsInPandas" in plan and "Window [" not in plan
    assert all("block" in line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line and "[" in line)


def test_default_alert_rules(spark):
    metrics = spark.createDataFrame(
        [("ingestion_rate_per_second", 0.0, 0), ("query_duration_ms_p99", 6000.0, 0), ("storage_free_percent", 50.0, 0), ("memory_alloc_mb", 2048.0, 0)],
        "name string, value double, at bigint",
    )
    outcome = {r.rule: r.triggered for r in al.evaluate_rules(metrics).collect()}
    assert outcome == {"high_ingestion_rate": False, "no_recent_logs": True, "slow_queries": True, "low_storage_space": False, "high_memory_usage": True}
    health = {r.component: r.status for r in k.health(metrics).collect()}
    assert health == {"ingestion": "degraded", "query_engine": "degraded"}


def test_charts(spark, logs, as_of):
    frame = spark.createDataFrame([("a", 1, "x"), ("b", 2, "5")], "l string, n int, t string")
    rows = {(r.label, r.series): r.value for r in d.chart_data(frame).collect()}
    assert rows == {("a", "n"): 1.0, ("a", "t"): 0.0, ("b", "n"): 2.0, ("b", "t"): 5.0}
    with pytest.raises(ValueError):
        d.chart_data(frame.select("l"))
    assert tuple(d.metric_data(frame.limit(0), "none").first()) == (0.0, "none")
    table = widget_data(logs, Widget("t", "table", spec=QuerySpec("q", ("id",), order_by=(OrderBy("id"),), limit=3)), as_of)
    assert [r.id for r in table.collect()] == ["log-000", "log-001", "log-002"]
    for bad in (Widget("t", "table"), Widget("t", "table", saved="nope")):
        with pytest.raises(ValueError):
            widget_data(logs, bad, as_of)


def test_latest_per_key(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, v int, t string")
    assert sorted(map(tuple, m.latest_per_key(frame, ["k"], ["v"]).collect())) == [("a", 3, "y"), ("b", 1, None)]


def test_latest_per_key_takes_any_columns(spark, logs):
    newest = m.latest_per_key(logs, ["service"], ["timestamp", "id"])
    assert newest.schema["attributes"].dataType == logs.schema["attributes"].dataType
    times = {r.service: r.t for r in logs.groupBy("service").agg(F.max("timestamp").alias("t")).collect()}
    assert {r.service: r.timestamp for r in newest.collect()} == times


def test_scatter_positions(spark):
    frame = spark.range(1000).selectExpr("id * 7 % 1000 AS k", "id * 7 % 1000 AS v").repartition(5)
    points = d.scatter_data(frame, "k")
    assert sorted((r.x, r.value) for r in points.collect()) == [(i, float(i)) for i in range(1000)]
    assert "SinglePartition" not in points._jdf.queryExecution().executedPlan().toString()
