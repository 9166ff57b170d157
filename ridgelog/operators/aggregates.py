"""Grouped counts over logs, merging of partial results, shard counts."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgelog.functions.scalars import start_of_minute


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a facet column."""
    return df.select(column).distinct()


def having(grouped: DataFrame, predicate: Column) -> DataFrame:
    """HAVING: a filter on the aliases of an aggregate."""
    return grouped.filter(predicate)


def message_length_profile(
    df: DataFrame, keys: Sequence[str] = ("service", "level"), min_rows: int = 0, exact: bool = True
) -> DataFrame:
    """Counts and message length statistics per key, only groups above ``min_rows``.

    The exact percentile keeps one counter per distinct length, and lengths are
    bounded, so a hot group does not grow the buffer. The distinct trace count is
    computed on its own: together with the percentile it would expand every row.
    """
    length = F.octet_length("message")
    p95 = F.percentile(length, F.lit(0.95)) if exact else F.percentile_approx(length, F.lit(0.95))
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.avg(length).alias("avg_message_length"),
        F.max(length).alias("max_message_length"),
        p95.alias("p95_message_length"),
    )
    traces = df.groupBy(*keys).agg(F.count_distinct("trace_id").alias("unique_traces"))
    return sizes.filter(F.col("total_logs") > min_rows).join(traces, list(keys))


def per_minute_activity(df: DataFrame) -> DataFrame:
    """Rows and distinct services per minute.

    One aggregate to (minute, service) carries both numbers, so the distinct
    count needs no second pass.
    """
    pairs = df.groupBy(start_of_minute("timestamp").alias("minute"), "service").agg(
        F.count(F.lit(1)).alias("n")
    )
    return pairs.groupBy("minute").agg(
        F.sum("n").alias("log_count"), F.count(F.lit(1)).alias("service_count")
    )


def grouped_values(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """groupArray in run-length form: per key the sorted (value, rows) pairs.

    The pairs carry the same information as the sorted array of all values, but
    grow with the distinct values, not with the rows of a hot key. For columns of low
    cardinality; ``value_rows`` keeps the pairs as rows.
    """
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(column).alias("value"), "rows"))).alias(f"{column}_rows")
    )


def concat_sources(sources: Sequence[DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """Concatenate several results by column name, skipping sources that cannot be read."""
    frames = []
    for source in sources:
        try:
            frames.append(source() if callable(source) else source)
        except AnalysisException:
            continue
    if not frames:
        raise ValueError("no readable source")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_partials(
    partials: Sequence[DataFrame | Callable[[], DataFrame]], keys: Sequence[str]
) -> DataFrame:
    """Merge per-node aggregates: numeric columns add up, others keep the first non-null.

    'First' follows the order of the partials and, inside one, the value order.
    """
    tagged = [
        (lambda p=p, i=i: (p() if callable(p) else p).withColumn("_source", F.lit(i)))
        for i, p in enumerate(partials)
    ]
    rows = concat_sources(tagged)
    merged = []
    for field in rows.schema.fields:
        if field.name in keys or field.name == "_source":
            continue
        column = F.col(field.name)
        if isinstance(field.dataType, T.NumericType):
            merged.append(F.sum(column).cast(field.dataType).alias(field.name))
        else:
            tagged_value = F.when(column.isNotNull(), F.struct("_source", column.alias("v")))
            merged.append(F.min(tagged_value)["v"].alias(field.name))
    return rows.groupBy(*keys).agg(*merged)


def shard_counts(df: DataFrame, key: str, shards: int = 16) -> DataFrame:
    """Rows and distinct keys per hash bucket of a key: how evenly a table would spread over ``shards`` writers.

    Rows are counted per key first, so each key is hashed once.
    """
    per_key = df.groupBy(F.col(key).cast("string").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    hashed = F.conv(F.left(F.md5("_key"), F.lit(8)), 16, 10).cast("bigint")
    return per_key.groupBy(F.pmod(hashed, F.lit(shards)).cast("int").alias("shard")).agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("keys")
    )


def value_rows(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows per key and value, one row each: ``grouped_values`` for columns with very many values."""
    return df.groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
