"""Parsing of raw lines: JSON logs, known text formats, routing and statistics."""

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelog.functions.patterns import LINE_PATTERNS, SEVERITY_LEVEL, LinePattern
from ridgelog.functions.scalars import _col, has_attr, merge_maps, ntz, present_attributes, trim_space, with_computed
from ridgelog.functions.timeparse import parse_json_timestamp, parse_timestamp
from ridgelog.operators.rules import DEFAULT_RULES, Record, RuleSet, is_valid, transform

# fixed values: keys of a JSON log and their aliases, in order of preference
JSON_LEVEL = ("level", "lvl")
JSON_MESSAGE = ("message", "msg", "text")
JSON_SERVICE = ("service", "app", "name")
JSON_TRACE = ("trace_id", "trace")
JSON_SPAN = ("span_id", "span")
JSON_FIELDS = ("timestamp", *JSON_LEVEL, "severity", *JSON_MESSAGE, *JSON_SERVICE, *JSON_TRACE, *JSON_SPAN)

# fixed values: names of captures that go to a log field
CAPTURE_FIELD = {
    "timestamp": ("timestamp", "time", "date"),
    "level": ("level", "severity", "priority"),
    "message": ("message", "msg", "text"),
    "service": ("service", "app", "component", "logger"),
    "trace_id": ("trace_id", "traceid", "trace"),
    "span_id": ("span_id", "spanid", "span"),
}
_FIELD_OF_CAPTURE = {name: field for field, names in CAPTURE_FIELD.items() for name in names}

NO_PARSER = "no suitable parser found"


def severity_to_level(severity) -> Column:
    """Standard level of a severity word; unknown words are info."""
    word = F.lower(_col(severity))
    level = F.when(word.isin(list(SEVERITY_LEVEL["fatal"])), F.lit("fatal"))
    for name in ("error", "warn", "info", "debug"):
        level = level.when(word.isin(list(SEVERITY_LEVEL[name])), F.lit(name))
    return level.otherwise(F.lit("info"))


def is_json_like(text) -> Column:
    trimmed = trim_space(text)
    return trimmed.startswith("{") & trimmed.endswith("}")


def needs_parsing(text) -> Column:
    """Gate: only text that looks like JSON or like a formatted log line is parsed."""
    text = _col(text)
    marks = [text.contains(m) for m in ("[", " - ", "HTTP/", "INFO", "ERROR", "WARN", "DEBUG")]
    return (text != "") & (is_json_like(text) | reduce(lambda a, b: a | b, marks))


def _string_member(doc: Column, key: str) -> Column:
    """A member of a JSON object, only when it is a string."""
    member = F.try_variant_get(doc, f"$.{key}", "variant")
    return F.when(
        F.schema_of_variant(member) == "STRING", F.try_variant_get(doc, f"$.{key}", "string")
    )


def _first_string(doc: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[_string_member(doc, k) for k in keys])


def json_attributes(text: Column) -> Column:
    """The members of a JSON object that are no log field."""
    members = F.from_json(text, "map<string,string>")
    return F.map_filter(members, lambda k, v: ~k.isin(list(JSON_FIELDS)) & v.isNotNull())


def json_record(text: Column, doc: Column, attributes: Column, as_of: datetime) -> Column:
    """The log struct of a JSON object."""
    level = F.coalesce(
        F.lower(_first_string(doc, JSON_LEVEL)),
        severity_to_level_or_null(_string_member(doc, "severity")),
        F.lit("info"),
    )
    return F.struct(
        F.coalesce(parse_json_timestamp(_string_member(doc, "timestamp")), ntz(as_of)).alias("timestamp"),
        level.alias("level"),
        F.coalesce(_first_string(doc, JSON_MESSAGE), text).alias("message"),
        F.coalesce(_first_string(doc, JSON_SERVICE), F.lit("unknown")).alias("service"),
        F.coalesce(_first_string(doc, JSON_TRACE), F.lit("")).alias("trace_id"),
        F.coalesce(_first_string(doc, JSON_SPAN), F.lit("")).alias("span_id"),
        attributes.alias("attributes"),
    )


def severity_to_level_or_null(severity) -> Column:
    severity = _col(severity)
    return F.when(severity.isNotNull(), severity_to_level(severity))


def parse_json_lines(df: DataFrame, column: str = "value", as_of: datetime | None = None) -> DataFrame:
    """Rows that hold a JSON object, as logs; other rows get a null ``record``."""
    doc = F.when(is_json_like(column), F.try_parse_json(F.col(column)))
    staged = df.withColumn("_doc", doc)
    is_json = F.col("_doc").isNotNull()
    # lambdas run outside of generated code, so the map is filtered in a projection of its own
    staged = staged.withColumn("_members", F.when(is_json, json_attributes(F.col(column))))
    record = json_record(F.col(column), F.col("_doc"), F.col("_members"), as_of)
    return with_computed(staged, "record", F.when(is_json, record)).drop("_doc", "_members")


def with_custom(patterns: Sequence[LinePattern], base: Sequence[LinePattern] = LINE_PATTERNS):
    """Default and custom patterns by falling priority; equal priorities keep their order."""
    return tuple(sorted((*base, *patterns), key=lambda p: -p.priority))


def _possible(text: Column, p: LinePattern) -> Column | None:
    """A cheap test that every line of the format passes: its first character, or text it must hold."""
    body = p.pattern.removeprefix("(?d)")
    if body.startswith("^<"):
        return text.startswith("<")
    if body.startswith(r"^(\d"):
        return F.ascii(text).between(ord("0"), ord("9"))
    return text.contains('] "') if r'\] "' in body else None


def pattern_matches(text: Column, p: LinePattern) -> Column:
    possible, hit = _possible(text, p), text.rlike(p.pattern)
    hit = hit if possible is None else possible & hit
    if p.forbidden is not None:
        group, token = p.forbidden
        hit = hit & ~F.regexp_extract(text, p.pattern, group).rlike(token)
    return hit


def pattern_index(text, patterns: Sequence[LinePattern]) -> Column:
    """Position of the first matching pattern, null when none matches."""
    text = _col(text)
    first, *rest = patterns
    index = F.when(pattern_matches(text, first), F.lit(0))
    for i, p in enumerate(rest, start=1):
        index = index.when(pattern_matches(text, p), F.lit(i))
    return index


_MARK = "\x01"


def _groups(text: Column, p: LinePattern) -> Column:
    """All groups of a matching line by one run of its pattern: the line is rewritten to them and split.

    A line that holds the mark itself has its groups taken one by one.
    """
    each = F.array(*[F.regexp_extract(text, p.pattern, i + 1) for i in range(len(p.groups))])
    if len(p.groups) == 1:
        return each
    whole = rf"\A[\s\S]*?(?:{p.pattern})[\s\S]*"
    joined = F.regexp_replace(text, whole, _MARK.join(f"${i + 1}" for i in range(len(p.groups))))
    return F.when(text.contains(_MARK), each).otherwise(F.split(joined, _MARK))


def _captured(text: Column, groups: Column, p: LinePattern) -> Column:
    """The fields of a line that matches ``p`` from its groups; time and level are still text."""
    captures: dict[str, Column] = {}
    for position, name in enumerate(p.groups):
        if name is None:
            continue
        value = groups[position]
        field = _FIELD_OF_CAPTURE.get(name, name)
        seen = captures.get(field)
        captures[field] = value if seen is None else F.when(value != "", value).otherwise(seen)

    def text_field(name: str, default: Column) -> Column:
        value = captures.pop(name, None)
        return default if value is None else F.when(value != "", trim_space(value)).otherwise(default)

    fields = {
        "time": captures.pop("timestamp", F.lit("")),
        "level": captures.pop("level", F.lit("")),
        "message": text_field("message", text),
        "service": text_field("service", F.lit("unknown")),
        "trace_id": text_field("trace_id", F.lit("")),
        "span_id": text_field("span_id", F.lit("")),
    }
    renamed, entries = dict(p.field_map), {}
    for name, value in captures.items():
        target = renamed.get(name, name)
        if name in renamed and target in ("level", "service", "trace_id", "span_id"):
            fields[target] = F.when(value != "", trim_space(value)).otherwise(fields[target])
        else:
            entries[target] = F.when(value != "", trim_space(value))
    entries["_parser"], entries["_pattern"] = F.lit("regex"), F.lit(p.name)
    attributes = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    return F.struct(*[c.alias(f) for f, c in fields.items()], attributes.alias("attributes"))


def with_text_record(
    df: DataFrame, column: str, name: str, patterns: Sequence[LinePattern], as_of: datetime, when: Column | None = None
) -> DataFrame:
    """Add the log struct of every line that matches a pattern, on the rows where ``when`` holds.

    First the pattern is chosen, then its groups are taken (only the matching
    branch is evaluated), then fields are formed and time and level are read.
    """
    text = F.col(column)
    index = pattern_index(text, patterns)
    staged = with_computed(df, "_index", index if when is None else F.when(when, index))

    def by_pattern(branch: Callable[[LinePattern], Column]) -> Column:
        first, *rest = patterns
        chain = F.when(F.col("_index") == 0, branch(first))
        for i, p in enumerate(rest, start=1):
            chain = chain.when(F.col("_index") == i, branch(p))
        return chain

    staged = with_computed(staged, "_groups", by_pattern(lambda p: _groups(text, p)))
    fields = by_pattern(lambda p: _captured(text, F.col("_groups"), p))
    staged = with_computed(staged, "_captured", fields)
    got = F.col("_captured")
    staged = staged.withColumn("_attributes", present_attributes(got["attributes"]))
    level = F.when(got["level"] != "", severity_to_level(got["level"])).otherwise(F.lit("info"))
    stamp = F.when(got["time"] != "", parse_timestamp(got["time"], as_of))
    record = F.struct(
        F.coalesce(stamp, ntz(as_of)).alias("timestamp"),
        level.alias("level"),
        *[got[f].alias(f) for f in ("message", "service", "trace_id", "span_id")],
        F.col("_attributes").alias("attributes"),
    )
    return with_computed(staged, name, F.when(got.isNotNull(), record)).drop(
        "_index", "_groups", "_captured", "_attributes"
    )


def parse_text_lines(
    df: DataFrame,
    column: str = "value",
    as_of: datetime | None = None,
    patterns: Sequence[LinePattern] = LINE_PATTERNS,
) -> DataFrame:
    """Match every line against the patterns; no match leaves a null ``record``."""
    return with_text_record(df, column, "record", with_custom((), patterns), as_of)


def parse_lines(
    df: DataFrame,
    column: str = "value",
    *,
    as_of: datetime,
    rules: RuleSet = DEFAULT_RULES,
    patterns: Sequence[LinePattern] = LINE_PATTERNS,
) -> DataFrame:
    """Route every line: JSON first, then the text formats, else a failed row.

    A candidate must pass validation before it is transformed. Adds the log
    fields plus ``parser``, ``success``, ``error`` and ``raw_message``. One pass
    over the data, no shuffle.
    """
    ranked = with_custom((), patterns)
    others = [c for c in df.columns if c != column]
    raw = F.col(column)
    staged = parse_json_lines(df, column, as_of).withColumnRenamed("record", "_json")
    json_ok = F.col("_json").isNotNull() & is_valid(Record.of_columns("_json."), rules)
    staged = with_computed(staged, "_json_ok", F.coalesce(json_ok, F.lit(False)))
    staged = with_text_record(staged, column, "_text", ranked, as_of, ~F.col("_json_ok"))
    text_ok = F.col("_text").isNotNull() & is_valid(Record.of_columns("_text."), rules)
    staged = with_computed(staged, "_text_ok", F.coalesce(text_ok, F.lit(False)))
    chosen = F.when(F.col("_json_ok"), F.col("_json")).when(F.col("_text_ok"), F.col("_text"))
    parser = F.when(F.col("_json_ok"), F.lit("json")).when(F.col("_text_ok"), F.lit("regex"))
    staged = with_computed(staged, "_chosen", chosen).withColumn("parser", F.coalesce(parser, F.lit("")))
    fields = ("timestamp", "level", "message", "service", "trace_id", "span_id", "attributes")
    flat = staged.select(
        *others,
        *[F.col("_chosen")[f].alias(f) for f in fields],
        "parser",
        (F.col("parser") != "").alias("success"),
        F.when(F.col("parser") == "", F.lit(NO_PARSER)).otherwise(F.lit("")).alias("error"),
        raw.alias("raw_message"),
    )
    return transform(flat, rules, as_of)


def merge_parsed(parsed: DataFrame, original_prefix: str = "orig_") -> DataFrame:
    """Combine a parse result with the log it came from.

    The parsed log wins, but a default service and empty trace and span ids keep
    the original value, and parsed attributes win over original ones. A failed
    parse keeps the original log.
    """

    def orig(name: str) -> Column:
        return F.col(original_prefix + name)

    ok = F.col("success")

    def keep(name: str, blank: str) -> Column:
        use_original = ~ok | ((F.col(name) == blank) & (orig(name) != ""))
        return F.when(use_original, orig(name)).otherwise(F.col(name))

    attributes = F.when(ok, merge_maps(orig("attributes"), F.col("attributes"))).otherwise(orig("attributes"))
    merged = parsed.withColumns(
        {
            "timestamp": F.when(ok, F.col("timestamp")).otherwise(orig("timestamp")),
            "level": F.when(ok, F.col("level")).otherwise(orig("level")),
            "message": F.when(ok, F.col("message")).otherwise(orig("message")),
            "service": keep("service", "unknown"),
            "trace_id": keep("trace_id", ""),
            "span_id": keep("span_id", ""),
            "attributes": attributes,
        }
    )
    return merged.drop(*[c for c in merged.columns if c.startswith(original_prefix)])


def parse_stored_messages(
    logs: DataFrame,
    *,
    as_of: datetime,
    rules: RuleSet = DEFAULT_RULES,
    patterns: Sequence[LinePattern] = LINE_PATTERNS,
) -> DataFrame:
    """Parse the messages of logs that pass the gate and merge the result back.

    ``parse_attempted`` and ``success`` tell what happened to each row.
    """
    fields = ("timestamp", "level", "message", "service", "trace_id", "span_id", "attributes")
    renamed = logs.select(
        "id",
        *[F.col(f).alias("orig_" + f) for f in fields],
        needs_parsing("message").alias("parse_attempted"),
        F.when(needs_parsing("message"), F.col("message")).otherwise(F.lit("")).alias("value"),
    )
    parsed = parse_lines(renamed, as_of=as_of, rules=rules, patterns=patterns)
    return merge_parsed(parsed).drop("raw_message", "error")


def parse_statistics(parsed: DataFrame) -> DataFrame:
    """Rows, successes and failures per parser ('' holds the failures)."""
    return parsed.groupBy("parser").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
    )


def parse_summary(parsed: DataFrame) -> DataFrame:
    """Totals over all parsers, one row."""
    return parsed.agg(
        F.count(F.lit(1)).alias("total_parsed"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.count_if(F.col("parser") == "json").alias("json_usage"),
        F.count_if(F.col("parser") == "regex").alias("regex_usage"),
    )


def has_pattern(name: str) -> Column:
    return has_attr("_pattern") & (F.col("attributes")["_pattern"] == name)
