"""Declarative queries: a spec is turned into DataFrame calls, no SQL text in between."""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelog.operators.filters import FILTER_OPERATORS, Filter, TimeRange, apply_filters
from ridgelog.schema import QUERY_FIELDS

_SIMPLE_AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
AGGREGATE_FUNCTIONS = ("COUNT", "COUNT_DISTINCT", *_SIMPLE_AGGREGATES)


@dataclass(frozen=True)
class Aggregation:
    function: str
    field: str = ""
    alias: str = ""
    #: trade exactness for a fixed-size sketch on very large distinct counts
    approximate: bool = False

    @property
    def name(self) -> str:
        return self.alias or f"{self.function.lower()}_{self.field}"


@dataclass(frozen=True)
class OrderBy:
    field: str
    direction: str = "ASC"


@dataclass(frozen=True)
class QuerySpec:
    name: str
    fields: Sequence[str] = ()
    filters: Sequence[Filter] = ()
    aggregations: Sequence[Aggregation] = ()
    group_by: Sequence[str] = ()
    order_by: Sequence[OrderBy] = ()
    limit: int = 0
    time_range: TimeRange | None = None


def validate_spec(spec: QuerySpec, known_fields: Sequence[str] = QUERY_FIELDS) -> None:
    """Raise ValueError on a missing name, unknown fields, operators or functions."""
    if not spec.name:
        raise ValueError("a query needs a name")
    known = set(known_fields)
    for name in spec.fields:
        if name not in known:
            raise ValueError(f"no such field: {name}")
    for f in spec.filters:
        if f.field not in known:
            raise ValueError(f"no such filter field: {f.field}")
        if f.operator not in FILTER_OPERATORS:
            raise ValueError(f"no such filter operator: {f.operator}")
    for a in spec.aggregations:
        if a.function not in AGGREGATE_FUNCTIONS:
            raise ValueError(f"no such aggregate: {a.function}")
        if a.field and a.field not in known:
            raise ValueError(f"no such aggregate field: {a.field}")


def aggregate_column(a: Aggregation) -> Column:
    if a.function == "COUNT":
        return (F.count(a.field) if a.field else F.count(F.lit(1))).alias(a.name)
    if a.function not in AGGREGATE_FUNCTIONS:
        raise ValueError(f"no such aggregate: {a.function}")
    if not a.field:
        raise ValueError(f"{a.function} needs a field")
    if a.function == "COUNT_DISTINCT":
        counter = F.approx_count_distinct if a.approximate else F.count_distinct
        return counter(F.col(a.field)).alias(a.name)
    return _SIMPLE_AGGREGATES[a.function](a.field).alias(a.name)


def order_columns(order_by: Sequence[OrderBy]) -> list[Column]:
    return [
        F.col(o.field).desc_nulls_last() if o.direction.upper() == "DESC" else F.col(o.field).asc_nulls_last()
        for o in order_by
    ]


def run_query(
    df: DataFrame, spec: QuerySpec, as_of: datetime | None = None, known_fields: Sequence[str] = QUERY_FIELDS
) -> DataFrame:
    """Validate the spec and build its plan."""
    validate_spec(spec, known_fields)
    df = apply_filters(df, spec.filters, spec.time_range, as_of)
    if spec.aggregations:
        aggregates = [aggregate_column(a) for a in spec.aggregations]
        df = df.groupBy(*spec.group_by).agg(*aggregates)
        df = df.select(*spec.fields, *[a.name for a in spec.aggregations])
    elif spec.group_by:
        df = df.select(*(spec.fields or spec.group_by)).distinct()
    elif spec.fields:
        df = df.select(*spec.fields)
    if spec.order_by:
        df = df.orderBy(*order_columns(spec.order_by))
    return df.limit(spec.limit) if spec.limit > 0 else df
