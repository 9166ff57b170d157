"""Regular expressions, written for Java from RE2 sources.

``re2`` rewrites the few constructs whose meaning differs: RE2's ``\\s`` has no
vertical tab, ``.`` excludes only the line feed and ``$`` is the end of the text.
Word boundaries are ASCII in RE2 and are written as look-arounds. Groups are
plain and addressed by index.
"""

import re
from dataclasses import dataclass

_SPACE = r"\t\n\f\r "


def re2(pattern: str, ignore_case: bool = False) -> str:
    """Java form of an RE2 pattern with plain groups."""
    text = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"[T\s", "[T" + _SPACE)
    text = text.replace(r'["\s', '["' + _SPACE).replace(r"[:\s", "[:" + _SPACE)
    # a word boundary before a word character, any other one
    text = re.sub(r"\\b(?=\w)", r"(?<!\\w)", text).replace(r"\b", r"(?!\w)")
    text = text.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    if text.endswith("$"):
        text = text[:-1] + r"\z"
    return ("(?diu)" if ignore_case else "(?d)") + text.replace("(?i)", "(?iu)")


@dataclass(frozen=True)
class LinePattern:
    """A line format: captures go to log fields or attributes by group name."""

    name: str
    pattern: str
    groups: tuple[str | None, ...]
    priority: int
    field_map: tuple[tuple[str, str], ...] = ()
    #: (group index, pattern) that must not occur inside that capture
    forbidden: tuple[int, str] | None = None


_NOT_SPACE = f"[^{_SPACE}]"
_IS_SPACE = f"[{_SPACE}]"
#: start of a token that is not of the form key=value
NOT_KEY_VALUE = rf"(?<!{_NOT_SPACE})(?!\w++={_NOT_SPACE}){_NOT_SPACE}"

# fixed values: the line formats as RE2 patterns
LINE_SOURCES = {
    "apache_combined": r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+|-) "([^"]*)" "([^"]*)"',
    "apache_common": r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+|-)',
    "nginx_access": r'^(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+) "([^"]*)" "([^"]*)"',
    "syslog_rfc3164": r"^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}) (\S+) (\S+)(\[(\d+)\])?: (.*)",
    "app_log": r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[.,]\d{3})\s+(\w+)\s+(\S+)\s+-\s+(.*)",
    "spring_boot": r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[.,]\d{3})\s+(\w+)\s+(\d+)\s+---\s+\[([^\]]+)\]\s+(\S+)\s+:\s+(.*)",
    "docker_log": r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(stdout|stderr)\s+F\s+(.*)",
    "generic_timestamped": r"^(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\s*(DEBUG|INFO|WARN|ERROR|FATAL|TRACE)?\s*(.+)",
    "level_message": r"^(DEBUG|INFO|WARN|ERROR|FATAL|TRACE):\s*(.+)",
    "key_value": r"^(.*?)(?:\s+((?:\w+=\S+\s*)+))$",
    "fallback": r"^(.+)$",
}

# fixed values: captures and priorities of the line formats
LINE_PATTERNS = (
    LinePattern(
        "apache_combined",
        re2(LINE_SOURCES["apache_combined"]),
        ("ip", "timestamp", "method", "path", "protocol", "status", "size", "referer", "user_agent"),
        90,
    ),
    LinePattern(
        "apache_common",
        re2(LINE_SOURCES["apache_common"]),
        ("ip", "timestamp", "method", "path", "protocol", "status", "size"),
        85,
    ),
    LinePattern(
        "nginx_access",
        re2(LINE_SOURCES["nginx_access"]),
        ("ip", "user", "timestamp", "method", "path", "protocol", "status", "size", "referer", "user_agent"),
        88,
    ),
    LinePattern(
        "syslog_rfc3164",
        re2(LINE_SOURCES["syslog_rfc3164"]),
        ("priority", "timestamp", "hostname", "service", None, "pid", "message"),
        95,
    ),
    LinePattern(
        "app_log",
        re2(LINE_SOURCES["app_log"]),
        ("timestamp", "level", "service", "message"),
        80,
    ),
    LinePattern(
        "spring_boot",
        re2(LINE_SOURCES["spring_boot"]),
        ("timestamp", "level", "pid", "thread", "logger", "message"),
        85,
    ),
    LinePattern(
        "docker_log",
        re2(LINE_SOURCES["docker_log"]),
        ("timestamp", "stream", "message"),
        75,
    ),
    LinePattern(
        "generic_timestamped",
        re2(LINE_SOURCES["generic_timestamped"]),
        ("timestamp", "level", "message"),
        60,
    ),
    LinePattern(
        "level_message",
        re2(LINE_SOURCES["level_message"]),
        ("level", "message"),
        50,
    ),
    # Not converted from its source, but written anew with the same matches:
    # a shortest message followed by key=value tokens up to the end. The message ends
    # with the last token that is no pair; without such a token it is the first token.
    # No nested repetition, so long lines neither blow up nor recurse.
    LinePattern(
        "key_value",
        rf"(?d)^(?>(.*(?<!{_NOT_SPACE})(?!\w++={_NOT_SPACE}){_NOT_SPACE}++)|(\w++={_NOT_SPACE}++)|)"
        rf"{_IS_SPACE}++(\w++={_NOT_SPACE}[\s\S]*)\z",
        ("message", "message", "kvpairs"),
        40,
        forbidden=(3, NOT_KEY_VALUE),
    ),
    LinePattern("fallback", re2(LINE_SOURCES["fallback"]), ("message",), 10),
)

SYSLOG_5424 = re2(r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.*)$")
SYSLOG_3164 = re2(r"^<(\d+)>(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?)(\[(\d+)\])?:\s*(.*)$")

# fixed values: syslog severities and facilities by number
SYSLOG_SEVERITY = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
SYSLOG_FACILITY = (
    "kernel", "user", "mail", "system", "security", "syslogd", "line-printer", "network-news",
    "uucp", "clock", "security2", "ftp", "ntp", "log-audit", "log-alert", "clock2",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)

# fixed values: severity words and the level they stand for; other words mean info
SEVERITY_LEVEL = {
    "fatal": ("emergency", "emerg", "panic"),
    "error": ("alert", "crit", "critical", "err", "error"),
    "warn": ("warning", "warn"),
    "info": ("notice", "info", "information"),
    "debug": ("debug",),
}

# fixed values: trace conventions as (trace attribute, span attribute, parent attribute, message
# pattern in RE2 syntax); every pattern needs one of the needles
TRACE_NEEDLES = ("trace", "Root=")
TRACE_CONVENTIONS = (
    ("trace_id", "span_id", "parent_span_id", r'trace[_-]?id["\s:=]+([a-fA-F0-9]{32})'),
    ("traceID", "spanID", "parentSpanID", r'"?traceID"?\s*:\s*"?([a-fA-F0-9]{32})"?'),
    ("traceId", "id", "parentId", r'"?traceId"?\s*:\s*"?([a-fA-F0-9]{16,32})"?'),
    ("trace_id", "id", "parent_id", r"Root=([0-9a-fA-F-]+);"),
)

# fixed values: operation names in messages as (pattern in RE2 syntax, group), ignoring case
OPERATION_PATTERNS = (
    (r"(GET|POST|PUT|DELETE|PATCH)\s+([^\s]+)", 0),
    (r"operation[:\s]+([^\s,]+)", 1),
    (r"method[:\s]+([^\s,]+)", 1),
    (r"calling\s+([^\s]+)", 1),
    (r"executing\s+([^\s]+)", 1),
)

# fixed values: levels that count as a detected error
ERROR_LEVELS = ("error", "err", "fatal", "panic", "critical", "crit", "alert", "emerg")

# fixed values: message patterns of the error detector in RE2 syntax as (name, category, pattern, needles).
# A match contains at least one of the needles, ignoring case, so a substring search decides
# most messages and the regular expression runs on the rest only.
ERROR_PATTERNS = (
    ("Exception", "application", r"(?i)(exception|error):\s*(.+)", ("exception:", "error:")),
    ("StackTrace", "application", r"(?i)^\s*at\s+[\w.$]+\(.*\)|\s+at\s+.+:\d+", ("(", ":")),
    ("NullPointer", "application", r"(?i)(null\s*pointer|null\s*reference|nil\s*pointer)", ("null", "nil")),
    ("OutOfMemory", "resource", r"(?i)(out\s*of\s*memory|oom|memory\s*exhausted)", ("oom", "memory")),
    ("HTTP4xx", "http", r"\b4\d{2}\b|(?i)(bad\s*request|unauthorized|forbidden|not\s*found)", ("4", "request", "unauthorized", "forbidden", "found")),
    ("HTTP5xx", "http", r"\b5\d{2}\b|(?i)(internal\s*server|gateway|service\s*unavailable)", ("5", "server", "gateway", "unavailable")),
    ("DatabaseConnection", "database", r"(?i)(connection\s*(refused|failed|timeout)|can't\s*connect|lost\s*connection)", ("connect",)),
    ("QueryError", "database", r"(?i)(sql\s*error|query\s*failed|syntax\s*error|deadlock)", ("error", "query", "deadlock")),
    ("DiskSpace", "system", r"(?i)(disk\s*(full|space)|no\s*space\s*left)", ("disk", "space")),
    ("Permission", "security", r"(?i)(permission\s*denied|access\s*denied|unauthorized\s*access)", ("denied", "unauthorized")),
    ("Timeout", "network", r"(?i)(timeout|timed?\s*out|deadline\s*exceeded)", ("time", "deadline")),
    ("Failed", "generic", r"(?i)\bfailed?\b|\bfailure\b", ("fail",)),
    ("Critical", "generic", r"(?i)\bcritical\b|\bfatal\b|\bpanic\b", ("critical", "fatal", "panic")),
)

#: ``field =`` and friends in query text
FIELD_COMPARISON = re2(r"(?<!\w)(\w+)\s*(?:=|>|<|>=|<=|IN|LIKE)")
