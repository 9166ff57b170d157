import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ridgelog.functions.patterns import LinePattern, re2
from ridgelog.functions.timeparse import parse_json_timestamp, parse_timestamp
from ridgelog.operators import parsing as p
from ridgelog.sources import ingest
from ridgelog.sources.syslog import decode_syslog

TEN_THIRTY = datetime(2024, 1, 15, 10, 30)


def parsed(make_lines, as_of, lines, **options):
    rows = p.parse_lines(make_lines(lines), as_of=as_of, **options).orderBy("n").collect()
    return rows


# (line, pattern, level, service, message, timestamp, attributes that must be present)
CASES = [
    (
        '192.168.1.1 - - [15/Jan/2024:10:30:00 +0000] "GET /api/users HTTP/1.1" 200 1234 "https://example.com/login" "Mozilla/5.0 (X11)"',
        "apache_combined", "info", "unknown", None, TEN_THIRTY,
        {"ip": "192.168.1.1", "method": "GET", "path": "/api/users", "status": "200", "size": "1234", "user_agent": "Mozilla/5.0 (X11)"},
    ),
    (
        '10.0.0.9 - bob [15/Jan/2024:11:30:00 +0100] "PUT /x HTTP/1.1" 204 -',
        "apache_common", "info", "unknown", None, TEN_THIRTY, {"ip": "10.0.0.9", "size": "-", "protocol": "HTTP/1.1"},
    ),
    ("<34>Jan 15 10:30:00 host cron: job done", "syslog_rfc3164", "info", "cron", "job done", TEN_THIRTY, {"hostname": "host"}),
    (
        "2024-01-15 10:30:00.123 WARN payment-service - Rate limit approaching: 85/100",
        "app_log", "warn", "payment-service", "Rate limit approaching: 85/100", datetime(2024, 1, 15, 10, 30, 0, 123000), {},
    ),
    (
        "2024-01-15 10:30:00,123  INFO 12345 --- [main] Controller : Starting",
        "spring_boot", "info", "Controller", "Starting", datetime(2024, 1, 15, 10, 30, 0, 123000), {"pid": "12345", "thread": "main"},
    ),
    (
        "2024-01-15T10:30:00.456Z stdout F Starting background job",
        "docker_log", "info", "unknown", "Starting background job", datetime(2024, 1, 15, 10, 30, 0, 456000), {"stream": "stdout"},
    ),
    ("2024-01-15T10:30:00Z ERROR Failed to validate", "generic_timestamped", "error", "unknown", "Failed to validate", TEN_THIRTY, {}),
    ("2024-01-15 10:30:00 FATAL gone", "generic_timestamped", "info", "unknown", "gone", TEN_THIRTY, {}),
    ("ERROR: Memory usage exceeded threshold: 95%", "level_message", "error", "unknown", "Memory usage exceeded threshold: 95%", None, {}),
    (
        "User login event user_id=789 ip=10.0.1.75 status=success", "key_value", "info", "unknown", "User login event", None,
        {"kvpairs": "user_id=789 ip=10.0.1.75 status=success"},
    ),
    ("a=b c=d", "key_value", "info", "unknown", "a=b", None, {"kvpairs": "c=d"}),
    ("Something happened", "fallback", "info", "unknown", "Something happened", None, {}),
    ("System event: backup done at 2024-01-15 10:34:00", "fallback", "info", "unknown", None, None, {}),
]


def test_every_line_format(make_lines, as_of):
    rows = parsed(make_lines, as_of, [c[0] for c in CASES])
    for row, (line, pattern, level, service, message, stamp, attributes) in zip(rows, CASES):
        assert (row.parser, row.success, row.attributes["_pattern"]) == ("regex", True, pattern), line
        assert (row.level, row.service) == (level, service), line
        assert row.message == (message or line)
        assert row.timestamp == (stamp or as_of), line
        for name, value in attributes.items():
            assert row.attributes[name] == value, (line, name)
        assert row.raw_message == line


def test_failed_lines(make_lines, as_of):
    dotted = "2024-01-15 10:30:00.123  INFO 1 --- [main] c.e.UserController : Starting"
    bracketed = "<34>Jan 15 10:30:00 web-server nginx[1234]: GET / 200"
    rows = parsed(make_lines, as_of, [dotted, bracketed, "two\nlines", "", "x" * 10001])
    assert [r.success for r in rows] == [False] * 5
    assert {r.error for r in rows} == {"no suitable parser found"}


def test_json_lines(make_lines, as_of):
    lines = [
        '{"timestamp": "2024-01-15T10:30:00Z", "lvl": "INFO", "msg": " Service started ", "app": "payment-service", "trace": "ab-01"}',
        '{"time": "2024-01-15T10:31:00Z", "level": "WARN", "text": "High memory", "component": "monitor", "user_id": "admin"}',
        '{"severity": "EMERG", "message": "x request_id=req-9", "name": "svc", "amount": 99.99, "tags": {"a": [1]}, "none": null}',
        '{"level": 3, "message": 5, "service": "numbers"}',
        '{"message": "bad service", "service": "a b"}',
        '{"broken":',
        '{"timestamp": "1705312800", "message": "no such layout here"}',
    ]
    rows = parsed(make_lines, as_of, lines)
    assert [r.parser for r in rows] == ["json", "json", "json", "json", "regex", "regex", "json"]
    first, second, third, fourth, fifth, sixth, seventh = rows
    assert (first.timestamp, first.level, first.message, first.service, first.trace_id) == (
        TEN_THIRTY, "info", "Service started", "payment-service", "ab-01",
    )
    assert (second.timestamp, second.level, second.message, second.service) == (as_of, "warn", "High memory", "unknown")
    assert second.attributes == {"time": "2024-01-15T10:31:00Z", "user_id": "admin"}
    assert (third.level, third.service) == ("fatal", "svc")
    assert third.attributes == {"amount": "99.99", "tags": '{"a":[1]}', "request_id": "req-9"}
    assert (fourth.level, fourth.message, fourth.service) == ("info", lines[3], "numbers")
    assert fifth.message == lines[4] and fifth.attributes["_pattern"] == "fallback"
    assert sixth.message == lines[5]
    assert seventh.timestamp == as_of


def test_custom_pattern_wins_by_priority(make_lines, as_of):
    mine = LinePattern("audit", re2(r"^\[AUDIT\] (\w+) (\w+) (.*)"), ("who", "sev", "message"), 99, (("who", "service"), ("sev", "level")))
    row = parsed(make_lines, as_of, ["[AUDIT] admin crit user removed"], patterns=p.with_custom([mine]))[0]
    assert (row.service, row.level, row.message) == ("admin", "error", "user removed")
    assert row.attributes == {"_parser": "regex", "_pattern": "audit"}


def test_key_value_equals_the_nested_expression(spark):
    """The rewritten pattern against the plain one, on short random texts."""
    plain = re.compile(r"\A(.*?)(?:[\t\n\f\r ]+((?:[A-Za-z0-9_]+=[^\t\n\f\r ]+[\t\n\f\r ]*)+))\Z")
    pattern = next(q for q in p.LINE_PATTERNS if q.name == "key_value")
    rng = random.Random(7)
    texts = {"".join(rng.choice("ab=  \n\t.") for _ in range(rng.randint(0, 14))) for _ in range(6000)}
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    text = F.col("value")
    got = frame.select(
        "value",
        p.pattern_matches(text, pattern).alias("hit"),
        F.concat(F.regexp_extract(text, pattern.pattern, 1), F.regexp_extract(text, pattern.pattern, 2)).alias("message"),
        F.regexp_extract(text, pattern.pattern, 3).alias("pairs"),
    ).collect()
    assert sum(r.hit for r in got) > 100
    for r in got:
        m = plain.search(r.value)
        assert r.hit == (m is not None), repr(r.value)
        if m:
            assert (r.message, r.pairs) == (m.group(1), m.group(2)), repr(r.value)


def test_long_key_value_line_is_parsed(make_lines, as_of):
    pairs = " ".join(f"k{i}=v" for i in range(1000))
    rows = parsed(make_lines, as_of, ["msg " + pairs, "msg " + pairs + " end"])
    assert rows[0].attributes["_pattern"] == "key_value" and rows[0].attributes["kvpairs"] == pairs
    assert rows[1].attributes["_pattern"] == "fallback"


TIMES = [
    ("2024-01-15T10:30:00Z", TEN_THIRTY),
    ("2024-01-15T10:30:00.123456Z", datetime(2024, 1, 15, 10, 30, 0, 123456)),
    ("2024-01-15T10:30:00.123456789Z", datetime(2024, 1, 15, 10, 30, 0, 123456)),
    ("2024-01-15T12:00:00+01:30", TEN_THIRTY),
    ("2024-01-15T09:00:00.5-01:30", datetime(2024, 1, 15, 10, 30, 0, 500000)),
    ("2024-01-15 10:30:00", TEN_THIRTY),
    ("2024-01-15 10:30:00,250", datetime(2024, 1, 15, 10, 30, 0, 250000)),
    ("2024/01/15 10:30:00", TEN_THIRTY),
    ("Jan 15 10:30:00", TEN_THIRTY),
    ("Jan  5 10:30:00", datetime(2024, 1, 5, 10, 30)),
    ("15/Jan/2024:10:30:00 +0000", TEN_THIRTY),
    ("15/Jan/2024:10:30:00 -0130", datetime(2024, 1, 15, 12, 0)),
    ("1705314600", TEN_THIRTY),
    ("1705314600123", datetime(2024, 1, 15, 10, 30, 0, 123000)),
    ("2024-02-30 10:30:00", None),
    ("2024-01-15T10:30:00", None),
    ("2024-01-15 25:30:00", None),
    ("2024-01-15", None),
    ("", None),
    ("soon", None),
]


def test_timestamp_layouts(spark, as_of):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "n int, t string")
    rows = frame.select("n", parse_timestamp("t", as_of).alias("all"), parse_json_timestamp("t").alias("json")).orderBy("n").collect()
    for row, (text, expected) in zip(rows, TIMES):
        assert row["all"] == expected, text
        iso = text[:2] == "20" and "/" not in text
        assert row["json"] == (expected if iso else None), text


def test_severity_words(spark):
    words = {"EMERG": "fatal", "panic": "fatal", "crit": "error", "Alert": "error", "err": "error", "Warning": "warn",
             "notice": "info", "debug": "debug", "FATAL": "info", "trace": "info", "": "info"}
    rows = spark.createDataFrame(list(words.items()), "w string, l string").select("l", p.severity_to_level("w").alias("got")).collect()
    assert all(r.l == r.got for r in rows)


def test_gate_and_merge(make_logs, as_of):
    logs = make_logs(
        [
            {"message": "ERROR: disk", "service": "edge", "trace_id": "abc", "attributes": {"_parser": "mine", "x": "1"}, "level": "info"},
            {"message": "nothing to see", "service": "edge", "level": "notice"},
            {"message": '{"message": "m", "service": "inner"}', "service": "edge", "level": "info"},
        ]
    )
    rows = p.parse_stored_messages(logs, as_of=as_of).orderBy("id").collect()
    assert [r.parse_attempted for r in rows] == [True, False, True]
    assert (rows[0].service, rows[0].trace_id, rows[0].level, rows[0].message) == ("edge", "abc", "error", "disk")
    assert rows[0].attributes["_parser"] == "regex" and rows[0].attributes["x"] == "1"
    assert (rows[1].message, rows[1].level, rows[1].success) == ("nothing to see", "notice", False)
    assert (rows[2].service, rows[2].message) == ("inner", "m")


def test_syslog(make_lines, as_of):
    lines = [
        '<165>1 2024-01-15T10:30:00.003Z host app 123 ID47 [a@1 k="v"] hello',
        "<34>Jan 15 10:30:00 web nginx[1234]: started",
        '<38>Jan 15 10:30:15 auth sshd: {"k": 1}',
        "plain words",
        "<13>1 - host app - - - no time",
    ]
    rows = decode_syslog(make_lines(lines), as_of=as_of).orderBy("n").collect()
    new, old, body, plain, untimed = rows
    assert (new.level, new.service, new.message) == ("notice", "app", "hello")
    assert new.attributes == {"facility": "local4", "hostname": "host", "procid": "123", "msgid": "ID47",
                              "structured_data": '[a@1 k="v"]', "version": "1", "format": "RFC5424"}
    assert (old.level, old.service, old.timestamp) == ("critical", "nginx", TEN_THIRTY)
    assert old.attributes == {"facility": "security", "hostname": "web", "format": "RFC3164", "pid": "1234"}
    assert body.attributes["raw_message"] == '{"k": 1}' and "pid" not in body.attributes
    assert (plain.level, plain.service, plain.attributes) == ("info", "syslog", {"format": "unknown"})
    assert untimed.timestamp == as_of


def test_bad_bodies_are_rejected_as_a_whole(make_lines, as_of, spark, tmp_path):
    bad = ['{"message": "cut', '[{"message": "a"}, {"message": ', '[1, 2]', '[{"message": "a"}, "b"]', '"text"', "12", "plain", "{", "[", '{"a":1} tail']
    good = ['{"message": "ok"}', '[]', '[{"message": "one"}, {"message": "two"}]', "", "  "]
    lines = make_lines(bad + good)
    assert sorted(r.message for r in ingest.decode_bodies(lines, as_of=as_of).collect()) == ["ok", "one", "two"]
    rejects = ingest.rejected_bodies(lines).collect()
    assert sorted(r.n for r in rejects) == list(range(len(bad))) and all(r.reason for r in rejects)
    (tmp_path / "logs.json").write_text("\n".join(bad + good) + "\n")
    assert ingest.read_json_logs(spark, str(tmp_path), as_of=as_of).count() == 3
    assert ingest.read_json_rejects(spark, str(tmp_path)).count() == len(bad)


def test_hostile_numbers_end_no_job(spark, make_lines, make_logs, as_of):
    from ridgelog.functions.timeparse import parse_timestamp
    from ridgelog.operators.errors import error_counts
    from ridgelog.sources.syslog import decode_syslog

    pri = make_lines(["<99999999999999>Jan 15 10:30:00 h a: m", "<" + "9" * 40 + ">Jan 15 10:30:00 h a: m", "<34>Jan 15 10:30:00 h a: m"])
    assert [r.attributes["facility"] for r in decode_syslog(pri, as_of=as_of).orderBy("n").collect()][1:] == ["kernel", "security"]
    codes = make_logs([{"attributes": {"status_code": c}} for c in ("99999999999", "NaN", "Infinity", "1e999", "404", "x")])
    assert [(r.category, r["count"]) for r in error_counts(codes).collect()] == [("http4xx", 1)]
    times = make_lines(["1705314600000000", "9" * 18, "9" * 30, "-5", "1705314600"]).select(parse_timestamp("value", as_of).alias("t"))
    assert times.count() == 5 and times.where("t = timestamp_ntz'2024-01-15 10:30:00'").count() == 1


def test_ingest_bodies_and_lines(make_lines, as_of):
    bodies = make_lines(['[{"message": "a", "level": "warn"}, {"id": "x", "message": "b", "attributes": {"n": 5}}]', '{"message": "c"}', "nonsense"])
    rows = sorted(ingest.decode_bodies(bodies, as_of=as_of).collect(), key=lambda r: r.message)
    assert [(r.message, r.level, r.service, r.timestamp) for r in rows] == [
        ("a", "warn", "unknown", as_of), ("b", "info", "unknown", as_of), ("c", "info", "unknown", as_of),
    ]
    assert rows[1].id == "x" and rows[1].attributes == {"n": "5"}
    assert len(rows[0].id) == 36 and rows[0].id != rows[2].id
    lines = make_lines(['{"message": "j", "service": "s"}', "text", "", '{"timestamp": "2024-01-15 10:30:00", "message": "k"}', '{"level": 5}'])
    got = {r.message: (r.level, r.service) for r in ingest.decode_lines(lines, as_of=as_of).collect()}
    assert got == {
        "j": ("info", "s"),
        "text": ("info", "tcp-client"),
        '{"timestamp": "2024-01-15 10:30:00", "message": "k"}': ("info", "tcp-client"),
        '{"level": 5}': ("info", "tcp-client"),
    }


def test_read_json_files(spark, tmp_path, as_of):
    (tmp_path / "logs.json").write_text('{"message": "a", "timestamp": "2024-01-15T10:30:00Z"}\n{"message": "b", "level": "error"}\n')
    rows = ingest.read_json_logs(spark, str(tmp_path), as_of=as_of).orderBy("message").collect()
    assert [(r.message, r.level, r.timestamp) for r in rows] == [("a", "info", TEN_THIRTY), ("b", "error", as_of)]


def test_invalid_rule_type_is_a_configuration_error(make_logs):
    from ridgelog.operators import rules as v

    with pytest.raises(ValueError):
        v.transform(make_logs([{}]), v.RuleSet(transforms=(v.TransformRule("x", "explode"),)))


def test_groups_of_any_pattern_in_one_run(make_lines, as_of):
    """Unanchored patterns, alternatives, optional groups and lines that hold the separator."""
    odd = LinePattern("odd", re2(r"user=(\w+)( id=(\d+))?|root:(\w*)"), ("user", None, "pid", "service"), 200)
    lines = make_lines(["login user=ann id=7 user=bob", "login user=eve!", "x root:db y", "a\x01b user=kim id=9"])
    rows = p.parse_text_lines(lines, as_of=as_of, patterns=(odd,)).orderBy("n").select("record.service", "record.attributes").collect()
    assert [(r.service, r.attributes.get("user"), r.attributes.get("pid")) for r in rows] == [
        ("unknown", "ann", "7"), ("unknown", "eve", None), ("db", None, None), ("unknown", "kim", "9"),
    ]
