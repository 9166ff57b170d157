"""Dashboard widgets: a data source, a query and the shape of the result."""

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from ridgelog.operators.charts import chart_data, metric_data
from ridgelog.operators.query import QuerySpec, run_query
from ridgelog.plans.sql import run_sql
from ridgelog.plans import templates

#: saved queries that a widget may name
SAVED: dict[str, Callable[..., DataFrame]] = {
    "errors_by_service": templates.errors_by_service,
    "levels_over_time": templates.levels_over_time,
    "slow_requests": templates.slow_requests,
    "top_error_sources": templates.top_error_sources,
}


@dataclass(frozen=True)
class Widget:
    title: str
    type: str
    spec: QuerySpec | None = None
    saved: str = ""
    sql: str = ""
    parameters: Mapping[str, Any] = field(default_factory=dict)


def widget_query(logs: DataFrame, widget: Widget, as_of: datetime) -> DataFrame:
    """The rows behind a widget, from a spec, a saved query or SQL."""
    if widget.spec is not None:
        return run_query(logs, widget.spec, as_of)
    if widget.saved:
        if widget.saved not in SAVED:
            raise ValueError(f"no such saved query: {widget.saved}")
        return SAVED[widget.saved](logs, as_of, **widget.parameters)
    if widget.sql:
        return run_sql(logs, widget.sql, widget.parameters)
    raise ValueError("a widget needs a spec, a saved query or SQL")


def widget_data(logs: DataFrame, widget: Widget, as_of: datetime) -> DataFrame:
    rows = widget_query(logs, widget, as_of)
    if widget.type == "chart":
        return chart_data(rows)
    if widget.type == "metric":
        return metric_data(rows, widget.title)
    return rows
