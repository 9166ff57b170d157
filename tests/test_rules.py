from ridgelog.operators import rules as v


def by_id(frame):
    return {r.id: r for r in frame.collect()}


def test_default_validation(make_logs):
    logs = make_logs(
        [
            {"message": "User login successful", "level": "info", "service": "auth-service", "trace_id": "abc-1"},
            {"message": "", "level": "info", "service": "s"},
            {"message": "m", "level": "INVALID_LEVEL", "service": "s"},
            {"message": "m", "level": "info", "service": "invalid service name!"},
            {"message": "x" * 15000, "level": "info", "service": "s"},
            {"message": "m", "level": "info", "service": "s", "trace_id": "trace-valid-001"},
            {"message": "你" * 3334, "level": "info", "service": "s"},
            {"message": "m", "service": "a" * 101},
        ]
    )
    rows = by_id(v.with_violations(logs))
    found = [rows[f"log-{i:03d}"].violations for i in range(8)]
    assert found[0] == []
    assert found[1] == ["required:message", "constraint:message:required", "rule:message_required"]
    assert found[2] == ["constraint:level:allowed_values", "rule:level_enum"]
    assert found[3] == ["constraint:service:pattern", "rule:service_format"]
    assert found[4] == ["constraint:message:max_length", "rule:message_length"]
    assert found[5] == ["constraint:trace_id:pattern"]
    assert found[6] == ["constraint:message:max_length", "rule:message_length"]
    assert found[7] == ["constraint:service:max_length"]
    assert set(by_id(v.validate(logs))) == {"log-000"}
    assert set(by_id(v.rejects(logs))) == {f"log-{i:03d}" for i in range(1, 8)}


def test_default_transformation(make_logs):
    logs = make_logs(
        [
            {"message": "  Payment failed user_id=user999 request_id: req-abc123  ", "level": "ERROR", "service": "t"},
            {"message": "", "attributes": {"msg": "mapped", "lvl": "WARN", "component": "c", "logger": "l", "app": "a", "keep": "1"}},
            {"message": "m", "service": "s", "level": "info", "attributes": {"app": "other"}},
            {"message": "plain"},
        ]
    )
    rows = by_id(v.transform(logs))
    first, second, third, fourth = (rows[f"log-{i:03d}"] for i in range(4))
    assert (first.message, first.level) == ("Payment failed user_id=user999 request_id: req-abc123", "error")
    assert first.attributes == {"user_id": "user999", "request_id": "req-abc123"}
    assert (second.message, second.level, second.service, second.attributes) == ("mapped", "warn", "a", {"keep": "1"})
    assert (third.service, third.attributes) == ("s", {})
    assert (fourth.level, fourth.service) == ("info", "unknown")


def test_enrichment_and_custom_steps(make_logs, as_of):
    rules = v.RuleSet(
        mappings=(("old", "new"),),
        defaults={"team": "core"},
        transforms=(
            v.TransformRule("a", "normalize", "new", function="uppercase"),
            v.TransformRule("b", "extract", "message", "span_id", pattern=r"span (\w+)"),
            v.TransformRule("c", "enrich", target="parsed_at"),
            v.TransformRule("d", "enrich", target="environment", replacement="prod"),
        ),
    )
    logs = make_logs([{"message": "span s1", "attributes": {"old": "x", "team": "mine"}}, {"message": "none", "span_id": "keep"}])
    rows = by_id(v.transform(logs, rules, as_of))
    stamp = {"parsed_at": "2024-01-31T00:00:00Z", "environment": "prod"}
    assert rows["log-000"].attributes == {"new": "X", "team": "mine", **stamp} and rows["log-000"].span_id == "s1"
    assert rows["log-001"].attributes == {"team": "core", **stamp} and rows["log-001"].span_id == "keep"


def test_report_counts_by_rule_and_service(make_logs):
    logs = make_logs([{"message": "", "service": "a"}, {"message": "", "service": "a"}, {"message": "m", "service": "b c"}])
    report = {(r.rule, r.service): r.failures for r in v.validity_report(logs).collect()}
    assert report[("rule:message_required", "a")] == 2 and report[("rule:service_format", "b c")] == 1
