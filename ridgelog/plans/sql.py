"""Parameterised, read-only SQL over the ``logs`` view."""

import re
from collections.abc import Mapping
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame

_QUERIES = ("select", "with")
_READ_ONLY = (*_QUERIES, "show", "describe", "explain")


def run_sql(
    logs: DataFrame,
    text: str,
    params: Mapping[str, Any] | None = None,
    max_rows: int | None = None,
    view: str = "logs",
) -> DataFrame:
    """Run ``text`` with ``:name`` or ``${name}`` bound by value, at most ``max_rows`` rows.

    Spark binds the parameters as typed literals, also inside INTERVAL and
    LIMIT, so no value is spliced into the text. A statement that would write is
    refused, also one that hides behind WITH.
    """
    first = text.split(None, 1)[0].lower() if text.strip() else ""
    if first not in _READ_ONLY:
        raise ValueError("only read-only statements are allowed")
    text = re.sub(r"\$\{(\w+)\}", r":\1", text)
    logs.createOrReplaceTempView(view)
    spark, bound = logs.sparkSession, dict(params or {})
    if first in _QUERIES:
        try:  # only a query can stand in parentheses; nothing runs here
            spark.sql(f"SELECT * FROM (\n{text.rstrip().rstrip(';')}\n)", args=bound)
        except ParseException as error:
            raise ValueError("only read-only statements are allowed") from error
    df = spark.sql(text, args=bound)
    return df if max_rows is None else df.limit(max_rows)
