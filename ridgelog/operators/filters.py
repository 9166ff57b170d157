"""Row predicates: declarative filters, time ranges, searches and tail filters."""

import operator
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelog.functions.scalars import attr, contains_ignore_case, ntz

# fixed values: relative ranges by name
RELATIVE_RANGES = {
    "last_1m": timedelta(minutes=1),
    "last_5m": timedelta(minutes=5),
    "last_15m": timedelta(minutes=15),
    "last_1h": timedelta(hours=1),
    "last_24h": timedelta(hours=24),
    "last_7d": timedelta(days=7),
    "last_30d": timedelta(days=30),
}

_COMPARISONS = {
    "equals": operator.eq,
    "not_equals": operator.ne,
    "greater_than": operator.gt,
    "less_than": operator.lt,
    "greater_equal": operator.ge,
    "less_equal": operator.le,
}
FILTER_OPERATORS = (
    *_COMPARISONS,
    "contains",
    "not_contains",
    "between",
    "in",
    "not_in",
    "is_null",
    "is_not_null",
)


@dataclass(frozen=True)
class Filter:
    """One condition; ``logical_op`` joins it to the condition before it."""

    field: str
    operator: str
    value: Any = None
    values: Sequence[Any] = ()
    logical_op: str = "AND"


@dataclass(frozen=True)
class TimeRange:
    """Absolute bounds (either may be open) or the name of a relative range."""

    start: datetime | None = None
    end: datetime | None = None
    relative: str = ""

    def bounds(self, as_of: datetime) -> tuple[datetime | None, datetime | None]:
        if not self.relative:
            return self.start, self.end
        if self.relative not in RELATIVE_RANGES:
            raise ValueError(f"no such relative range: {self.relative}")
        return as_of - RELATIVE_RANGES[self.relative], as_of


def _literal(value: Any) -> Column:
    if isinstance(value, bool):
        return F.lit(int(value))
    if isinstance(value, datetime):
        return ntz(value)
    return F.lit(value)


def condition(f: Filter) -> Column:
    """The predicate of one filter. ``contains`` is LIKE: % and _ stay wildcards."""
    field = F.col(f.field)
    if f.operator in _COMPARISONS:
        return _COMPARISONS[f.operator](field, _literal(f.value))
    if f.operator == "contains":
        return field.like(f"%{f.value}%")
    if f.operator == "not_contains":
        return ~field.like(f"%{f.value}%")
    if f.operator == "between":
        if len(f.values) != 2:
            raise ValueError("between needs exactly two values")
        return field.between(_literal(f.values[0]), _literal(f.values[1]))
    if f.operator in ("in", "not_in"):
        if not f.values:
            raise ValueError(f"{f.operator} needs at least one value")
        member = field.isin([_literal(v) for v in f.values])
        return member if f.operator == "in" else ~member
    if f.operator == "is_null":
        return field.isNull()
    if f.operator == "is_not_null":
        return field.isNotNull()
    raise ValueError(f"no such filter operator: {f.operator}")


def combine(filters: Sequence[Filter]) -> Column | None:
    """AND binds tighter than OR; a filter without connective is joined by AND."""
    arms: list[list[Column]] = []
    for position, f in enumerate(filters):
        if position == 0 or f.logical_op.upper() == "OR":
            arms.append([])
        arms[-1].append(condition(f))
    if not arms:
        return None
    return reduce(operator.or_, [reduce(operator.and_, arm) for arm in arms])


def time_filter(
    df: DataFrame, start: datetime | None, end: datetime | None, column: str = "timestamp"
) -> DataFrame:
    """Rows with ``start <= timestamp <= end``.

    A stored table also gets the bounds on its partition column, which the
    optimizer cannot derive from the timestamp, so old partitions are not listed.
    """
    for moment, test in ((start, operator.ge), (end, operator.le)):
        if moment is not None:
            df = df.filter(test(F.col(column), ntz(moment)))
            for name, key in _PARTITION_KEYS.items():
                if name in df.columns:
                    stored = F.col(name) if name == "date_partition" else F.col(name).cast("int")
                    df = df.filter(test(stored, F.lit(key(moment))))
    return df


#: the partition of a moment, by the partition column of a stored table
_PARTITION_KEYS = {
    "date_partition": lambda at: at.date(),
    "week_partition": lambda at: at.isocalendar().year * 100 + at.isocalendar().week,
    "month_partition": lambda at: at.year * 100 + at.month,
}


def _day_of(value: Any) -> date | None:
    if isinstance(value, datetime):
        return value.date()
    try:
        return date.fromisoformat(str(value)[:10])
    except ValueError:
        return None


def _implied_days(filters: Sequence[Filter]) -> Column | None:
    """Bounds on ``date_partition`` that follow from AND-joined filters on the timestamp."""
    if any(f.logical_op.upper() == "OR" for f in filters[1:]):
        return None
    bounds = []
    for f in filters:
        if f.field != "timestamp":
            continue
        if f.operator == "between":
            low, high = f.values
        else:
            low = f.value if f.operator in ("equals", "greater_than", "greater_equal") else None
            high = f.value if f.operator in ("equals", "less_than", "less_equal") else None
        for value, test in ((low, operator.ge), (high, operator.le)):
            day = None if value is None else _day_of(value)
            if day is not None:
                bounds.append(test(F.col("date_partition"), F.lit(day)))
    return reduce(operator.and_, bounds) if bounds else None


def apply_filters(
    df: DataFrame,
    filters: Sequence[Filter] = (),
    time_range: TimeRange | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Time range over the whole predicate, then the combined filters."""
    if time_range is not None:
        df = time_filter(df, *time_range.bounds(as_of))
    predicate = combine(filters)
    if predicate is None:
        return df
    days = _implied_days(filters) if "date_partition" in df.columns else None
    return df.filter(predicate if days is None else predicate & days)


def search_logs(
    df: DataFrame,
    *,
    start: datetime,
    end: datetime,
    service: str = "",
    level: str = "",
    trace_id: str = "",
    search: str = "",
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Log search, newest first; the substring is literal and case-insensitive."""
    df = time_filter(df, start, end)
    for name, wanted in (("service", service), ("level", level), ("trace_id", trace_id)):
        if wanted:
            df = df.filter(F.col(name) == wanted)
    if search:
        df = df.filter(contains_ignore_case("message", search))
    df = df.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit > 0 else df


_TAIL_TESTS = {
    "equals": lambda c, v: c == v,
    "=": lambda c, v: c == v,
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "not_equals": lambda c, v: c != v,
    "!=": lambda c, v: c != v,
    "not_contains": lambda c, v: ~c.contains(v),
}


def tail_condition(filters: Iterable[Mapping[str, str]]) -> Column:
    """All filters hold, ignoring case; an unknown operator never matches.

    Fields other than level, service, message and trace_id are attributes.
    Batch and stream share this predicate.
    """
    predicate = F.lit(True)
    for f in filters:
        name = f["field"]
        known = name in ("level", "service", "message", "trace_id")
        text = F.lower(F.col(name) if known else attr(name))
        test = _TAIL_TESTS.get(f["operator"])
        predicate = predicate & (test(text, f["value"].lower()) if test else F.lit(False))
    return predicate


def export_rows(
    df: DataFrame,
    filters: Iterable[Mapping[str, str]] = (),
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int = 0,
) -> DataFrame:
    """Rows to export, newest first. Comparisons are on text; unknown operators are ignored."""
    df = time_filter(df, start, end)
    for f in filters:
        field, value = F.col(f["field"]), f["value"]
        if f["operator"] == "=":
            df = df.filter(field == F.lit(value))
        elif f["operator"] == "!=":
            df = df.filter(field != F.lit(value))
        elif f["operator"] == "contains":
            df = df.filter(field.like(f"%{value}%"))
        elif f["operator"] == ">":
            df = df.filter(field > F.lit(value))
        elif f["operator"] == "<":
            df = df.filter(field < F.lit(value))
    df = df.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return df.limit(limit) if limit > 0 else df


def quick_search(df: DataFrame, term: str) -> DataFrame:
    """Term in the message, the service or the level, ignoring case."""
    hit = reduce(operator.or_, [contains_ignore_case(c, term) for c in ("message", "service", "level")])
    return df.filter(hit)


def facet_filter(df: DataFrame, *, level: str = "", service: str = "", term: str = "") -> DataFrame:
    """Exact level and service, message search ignoring case; '' means any."""
    if level:
        df = df.filter(F.col("level") == level)
    if service:
        df = df.filter(F.col("service") == service)
    if term:
        df = df.filter(contains_ignore_case("message", term))
    return df


def in_subquery(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``column IN (SELECT column FROM keys)`` as a left semi join.

    No hint: the planner broadcasts ``keys`` only below its size threshold and
    AQE splits a skewed side.
    """
    return df.join(keys.select(column), column, "left_semi")
