"""Row rules: validation, transformation and the default rule set.

Rules work on a ``Record``: Columns for the five text fields and one for the
attribute map. That lets them run on a table as well as on the candidate
structs of the line parser.
"""

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelog.functions.patterns import re2
from ridgelog.functions.scalars import attr, compact_texts, trim_space
from ridgelog.schema import TEXT_FIELDS


@dataclass(frozen=True)
class Record:
    fields: Mapping[str, Column]
    attributes: Column

    @classmethod
    def of_columns(cls, prefix: str = "") -> "Record":
        return cls({f: F.col(prefix + f) for f in TEXT_FIELDS}, F.col(prefix + "attributes"))

    def value(self, name: str) -> Column:
        """Text of a core field or attribute, '' when missing."""
        if name in self.fields:
            return F.coalesce(self.fields[name], F.lit(""))
        return attr(name, self.attributes)

    def with_value(self, name: str, value: Column, when: Column) -> "Record":
        """Set a core field or attribute on the rows where ``when`` holds."""
        if name in self.fields:
            changed = F.when(when, value).otherwise(self.fields[name])
            return replace(self, fields={**self.fields, name: changed})
        kept = F.map_filter(self.attributes, lambda k, _: k != name)
        changed = F.when(when, F.map_concat(kept, F.create_map(F.lit(name), value)))
        return replace(self, attributes=changed.otherwise(self.attributes))


@dataclass(frozen=True)
class Constraint:
    """Limits of one field; all but ``required`` are skipped for an empty value."""

    field: str
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    pattern: str = ""
    allowed: Sequence[str] = ()


@dataclass(frozen=True)
class ValidationRule:
    """Named rule of type required, regex, range (byte length) or enum."""

    name: str
    field: str
    type: str
    pattern: str = ""
    min_length: int | None = None
    max_length: int | None = None
    allowed: Sequence[str] = ()


@dataclass(frozen=True)
class TransformRule:
    """Named step of type normalize, extract or enrich."""

    name: str
    type: str
    field: str = ""
    target: str = ""
    pattern: str = ""
    replacement: str = ""
    function: str = ""


@dataclass(frozen=True)
class RuleSet:
    required: Sequence[str] = ()
    constraints: Sequence[Constraint] = ()
    validations: Sequence[ValidationRule] = ()
    #: (source attribute, target); earlier entries win when several fit
    mappings: Sequence[tuple[str, str]] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)
    transforms: Sequence[TransformRule] = ()


# fixed values: the default rules
LEVELS = ("debug", "info", "warn", "error", "fatal", "trace")
SERVICE_PATTERN = r"^[a-zA-Z0-9_-]+$"
TRACE_PATTERN = r"^[a-fA-F0-9_-]+$"
DEFAULT_RULES = RuleSet(
    required=("message",),
    constraints=(
        Constraint("level", allowed=LEVELS),
        Constraint("message", required=True, min_length=1, max_length=10000),
        Constraint("service", pattern=SERVICE_PATTERN, max_length=100),
        Constraint("trace_id", pattern=TRACE_PATTERN, max_length=64),
    ),
    validations=(
        ValidationRule("message_required", "message", "required"),
        ValidationRule("level_enum", "level", "enum", allowed=LEVELS),
        ValidationRule("message_length", "message", "range", min_length=1, max_length=10000),
        ValidationRule("service_format", "service", "regex", pattern=SERVICE_PATTERN),
    ),
    mappings=(
        ("msg", "message"),
        ("lvl", "level"),
        ("app", "service"),
        ("component", "service"),
        ("logger", "service"),
    ),
    defaults={"level": "info", "service": "unknown"},
    transforms=(
        TransformRule("normalize_level", "normalize", "level", function="lowercase"),
        TransformRule("trim_message", "normalize", "message", function="trim"),
        TransformRule(
            "extract_user_id", "extract", "message", "user_id", r"user_id[=:]\s*([a-zA-Z0-9_-]+)"
        ),
        TransformRule(
            "extract_request_id", "extract", "message", "request_id", r"request_id[=:]\s*([a-zA-Z0-9_-]+)"
        ),
    ),
)


def required_failed(record: Record, name: str) -> Column:
    return record.value(name) == ""


def _limits(value: Column, min_length, max_length, pattern, allowed) -> dict[str, Column]:
    """Failed checks of a non-empty value, by kind."""
    size = F.octet_length(value)
    checks = {}
    if min_length is not None:
        checks["min_length"] = size < min_length
    if max_length is not None:
        checks["max_length"] = size > max_length
    if pattern:
        checks["pattern"] = ~value.rlike(re2(pattern))
    if allowed:
        checks["allowed_values"] = ~value.isin(list(allowed))
    return checks


def constraint_violations(record: Record, c: Constraint) -> list[Column]:
    value = record.value(c.field)
    label = f"constraint:{c.field}:"
    found = []
    if c.required:
        found.append(F.when(value == "", F.lit(label + "required")))
    for kind, failed in _limits(value, c.min_length, c.max_length, c.pattern, c.allowed).items():
        found.append(F.when((value != "") & failed, F.lit(label + kind)))
    return found


def rule_failed(record: Record, rule: ValidationRule) -> Column:
    value = record.value(rule.field)
    if rule.type == "required":
        return value == ""
    if rule.type == "regex":
        checks = _limits(value, None, None, rule.pattern, ())
    elif rule.type == "range":
        checks = _limits(value, rule.min_length, rule.max_length, "", ())
    elif rule.type == "enum":
        checks = _limits(value, None, None, "", rule.allowed)
    else:
        checks = {}
    failed = F.lit(False)
    for check in checks.values():
        failed = failed | check
    return (value != "") & failed


def violations(record: Record, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Names of everything a record violates, as an array; empty for a valid record."""
    found = [F.when(required_failed(record, f), F.lit(f"required:{f}")) for f in rules.required]
    for c in rules.constraints:
        found.extend(constraint_violations(record, c))
    for rule in rules.validations:
        found.append(F.when(rule_failed(record, rule), F.lit(f"rule:{rule.name}")))
    return compact_texts(found) if found else F.array().cast("array<string>")


def is_valid(record: Record, rules: RuleSet = DEFAULT_RULES) -> Column:
    """The boolean form of ``violations``, without building the array."""
    bad = F.lit(False)
    for f in rules.required:
        bad = bad | required_failed(record, f)
    for c in rules.constraints:
        for violation in constraint_violations(record, c):
            bad = bad | violation.isNotNull()
    for rule in rules.validations:
        bad = bad | rule_failed(record, rule)
    return ~bad


def with_violations(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return df.withColumn("violations", violations(Record.of_columns(), rules)).withColumn(
        "is_valid", F.size("violations") == 0
    )


def validate(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Valid rows only."""
    return df.filter(is_valid(Record.of_columns(), rules))


def rejects(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The rows ``validate`` drops, with their violations."""
    return with_violations(df, rules).filter(~F.col("is_valid")).drop("is_valid")


def validity_report(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Failures by rule and service."""
    checked = df.select("service", F.explode(violations(Record.of_columns(), rules)).alias("rule"))
    return checked.groupBy("rule", "service").agg(F.count(F.lit(1)).alias("failures"))


def apply_mappings(record: Record, rules: RuleSet) -> Record:
    """Move attributes to fields that are still empty; the source keys disappear."""
    source_map = record.attributes
    for source, target in rules.mappings:
        value = source_map[source]
        if target in record.fields:
            record = record.with_value(target, value, value.isNotNull() & (record.value(target) == ""))
        else:
            record = record.with_value(target, value, value.isNotNull())
    sources = [source for source, _ in rules.mappings]
    if sources:
        present = reduce(operator.or_, [source_map[name].isNotNull() for name in sources])
        kept = F.when(present, F.map_filter(record.attributes, lambda k, _: ~k.isin(sources)))
        record = replace(record, attributes=F.coalesce(kept, record.attributes))
    return record


def apply_defaults(record: Record, rules: RuleSet) -> Record:
    for name, default in rules.defaults.items():
        if name in record.fields:
            empty = record.value(name) == ""
        else:
            empty = record.attributes[name].isNull()
        record = record.with_value(name, F.lit(default), empty)
    return record


_NORMALIZERS = {"lowercase": F.lower, "uppercase": F.upper, "trim": trim_space}


def _normalize(record: Record, rule: TransformRule) -> Record:
    if rule.function not in _NORMALIZERS:
        raise ValueError(f"no such normalization: {rule.function}")
    value = record.value(rule.field)
    present = value != "" if rule.field in record.fields else record.attributes[rule.field].isNotNull()
    return record.with_value(rule.field, _NORMALIZERS[rule.function](value), present)


def _extract(record: Record, rule: TransformRule) -> Record:
    if not rule.pattern or not rule.target:
        raise ValueError("an extraction needs a pattern and a target")
    value, pattern = record.value(rule.field), re2(rule.pattern)
    return record.with_value(rule.target, F.regexp_extract(value, pattern, 1), value.rlike(pattern))


def _enrich(record: Record, rule: TransformRule, as_of: datetime | None) -> Record:
    always = F.lit(True)
    if rule.target == "parsed_at":
        if as_of is None:
            raise ValueError("parsed_at needs as_of")
        return record.with_value("parsed_at", F.lit(as_of.strftime("%Y-%m-%dT%H:%M:%SZ")), always)
    if rule.target == "environment" and rule.replacement:
        return record.with_value("environment", F.lit(rule.replacement), always)
    return record


def transform_record(record: Record, rules: RuleSet = DEFAULT_RULES, as_of: datetime | None = None) -> Record:
    """Mappings, defaults, then the transform rules in order."""
    record = apply_defaults(apply_mappings(record, rules), rules)
    for rule in rules.transforms:
        if rule.type == "normalize":
            record = _normalize(record, rule)
        elif rule.type == "extract":
            record = _extract(record, rule)
        elif rule.type == "enrich":
            record = _enrich(record, rule, as_of)
        elif rule.type != "filter":
            raise ValueError(f"transform rule {rule.name!r}: unknown type {rule.type!r}")
    return record


def transform(df: DataFrame, rules: RuleSet = DEFAULT_RULES, as_of: datetime | None = None) -> DataFrame:
    """Apply the rule set to a log table, one projection per step.

    Separate projections keep each expression small: the optimizer merges them
    only where that does not repeat work.
    """

    def put(frame: DataFrame, record: Record) -> DataFrame:
        return frame.withColumns({**record.fields, "attributes": record.attributes})

    df = put(df, apply_mappings(Record.of_columns(), rules))
    df = put(df, apply_defaults(Record.of_columns(), rules))
    for rule in rules.transforms:
        step = RuleSet(transforms=(rule,))
        df = put(df, transform_record(Record.of_columns(), step, as_of))
    return df
