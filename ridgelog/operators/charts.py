"""Shaping of query results for charts, metrics and tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelog.functions.positions import numbered


def _number(c: Column) -> Column:
    value = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def chart_data(df: DataFrame) -> DataFrame:
    """First column as label, every other column as a series of (label, series, value).

    Values that are no numbers become 0.
    """
    label, *series = df.columns
    if not series:
        raise ValueError("a chart needs a label and at least one series")
    wide = df.select(
        F.col(label).cast("string").alias("label"),
        *[_number(F.col(c).cast("string")).alias(c) for c in series],
    )
    return wide.unpivot("label", series, "series", "value")


def metric_data(df: DataFrame, label: str) -> DataFrame:
    """The first value of the first row, 0 when there is none, as one row."""
    first = df.limit(1).select(_number(F.col(df.columns[0]).cast("string")).alias("v"))
    return first.agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("value")).withColumn("label", F.lit(label))


def table_rows(df: DataFrame, rows: int) -> DataFrame:
    return df.limit(rows)


def pie_data(df: DataFrame) -> DataFrame:
    """Slices of the first series only."""
    first = df.columns[1]
    return chart_data(df.select(df.columns[0], first)).select("label", "value")


def scatter_data(df: DataFrame, order: str) -> DataFrame:
    """Points with the position of the row in the order of a column as x.

    Rows are dealt out by range and numbered within their task; a task starts
    behind the rows of the tasks before it, which are counted, one row each.
    """
    rows = numbered(df, [order], "_position").select(F.col("_position").alias("x"), *df.columns[1:])
    return chart_data(rows).withColumnRenamed("label", "x").withColumn("x", F.col("x").cast("bigint"))
