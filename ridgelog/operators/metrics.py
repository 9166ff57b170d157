"""Histograms, bucketed percentiles, sliding rates, counter rates, snapshots, health."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelog.functions.scalars import epoch_micros, from_epoch_micros

# fixed values: upper bounds of the default histogram
BUCKETS = (0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0)
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
RATE_WINDOW = 60


def bucket_index(value, buckets: Sequence[float] = BUCKETS) -> Column:
    """Index of the first bound that is not below the value; past the last one overflows."""
    value = value if isinstance(value, Column) else F.col(value)
    index = F.lit(len(buckets))
    for i in reversed(range(len(buckets))):
        index = F.when(value <= buckets[i], F.lit(i)).otherwise(index)
    return index


def histogram(
    df: DataFrame, value: str, keys: Sequence[str] = (), buckets: Sequence[float] = BUCKETS
) -> DataFrame:
    """Rows per bucket, empty buckets left out; the bound of the overflow is infinity."""
    bounds = F.array(*[F.lit(float(b)) for b in buckets], F.lit(float("inf")))
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, bucket_index(value, buckets).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.withColumn("upper_bound", F.element_at(bounds, F.col("bucket") + 1))


def _histogram_aggregates(v: Column, buckets: Sequence[float]) -> list[Column]:
    return [
        F.count(v).alias("count"),
        F.sum(v).alias("sum"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *[F.count_if(v <= b).alias(f"_le{i}") for i, b in enumerate(buckets)],
    ]


def _histogram_columns(buckets: Sequence[float]) -> list[Column]:
    """The statistics as doubles, 0 for an empty histogram; the count stays a number of rows."""
    zero = F.lit(0.0)

    def percentile(p: float) -> Column:
        target = (F.col("count") * F.lit(p)).cast("bigint")
        reached = F.col("max")
        for i in reversed(range(len(buckets))):
            reached = F.when(F.col(f"_le{i}") >= target, F.lit(float(buckets[i]))).otherwise(reached)
        return F.when(F.col("count") == 0, zero).otherwise(reached)

    return [
        F.col("count"),
        F.coalesce("sum", zero).alias("sum"),
        F.when(F.col("count") == 0, zero).otherwise(F.col("sum") / F.col("count")).alias("avg"),
        F.coalesce("min", zero).alias("min"),
        F.coalesce("max", zero).alias("max"),
        *[percentile(p).alias(name) for name, p in PERCENTILES.items()],
    ]


def histogram_stats(
    df: DataFrame, value: str, keys: Sequence[str] = (), buckets: Sequence[float] = BUCKETS
) -> DataFrame:
    """count, sum, avg, min, max and bucketed percentiles in one hash aggregate.

    Cumulative bucket counts are aggregated directly, so a percentile is a
    comparison of a few columns and the state per group has a fixed size. A
    percentile is the bound of the bucket that reaches int(count * p), or the
    maximum in the overflow.
    """
    rows = df.filter(F.col(value).isNotNull())
    stats = rows.groupBy(*keys).agg(*_histogram_aggregates(F.col(value), buckets))
    return stats.select(*keys, *_histogram_columns(buckets))


def per_second(df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Events per second: the bounded input of the sliding rate."""
    second = F.floor(epoch_micros(ts) / 1_000_000).cast("bigint")
    return df.groupBy(*keys, second.alias("second")).agg(F.count(F.lit(1)).alias("events"))


def sliding_rate(
    df: DataFrame, keys: Sequence[str] = (), window: int = RATE_WINDOW, ts: str = "timestamp"
) -> DataFrame:
    """Events of the last ``window`` seconds divided by ``window``, at every active second.

    Time is cut into blocks of one window length. Each second also goes to the
    next block as history, so every block is complete on its own: no window
    partition spans more than two blocks, with or without keys.
    """
    seconds = per_second(df, keys, ts)
    block = F.floor(F.col("second") / window)
    spread = seconds.withColumn("carried", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "block", block + F.col("carried")
    )
    w = Window.partitionBy(*keys, "block").orderBy("second").rangeBetween(-(window - 1), 0)
    rated = spread.withColumn("in_window", F.sum("events").over(w))
    return rated.filter(F.col("carried") == 0).select(
        *keys,
        from_epoch_micros(F.col("second") * 1_000_000).alias("second"),
        "events",
        (F.col("in_window") / F.lit(float(window))).alias("rate"),
    )


def sample_series(
    df: DataFrame, keys: Sequence[str], value: str, step: int, ts: str = "timestamp", tie: str = "id"
) -> DataFrame:
    """Last value per key and step: the scrape grid that bounds a series by time."""
    at = (F.floor(epoch_micros(ts) / (step * 1_000_000)) * step).cast("bigint")
    last = F.max(F.struct(ts, tie, F.col(value).alias("v")))
    return df.groupBy(*keys, at.alias("at")).agg(last.alias("last")).select(*keys, "at", F.col("last.v").alias("value"))


def counter_increase(
    series: DataFrame, keys: Sequence[str], window: int, value: str = "value", at: str = "at"
) -> DataFrame:
    """Increase and rate of a counter over the last ``window`` seconds, resets included.

    A drop means the counter restarted, so the new value is the increase. Input
    is a sampled series; see ``sample_series``.
    """
    by_time = Window.partitionBy(*keys).orderBy(at)
    previous = F.lag(value).over(by_time)
    step = F.when(previous.isNull(), F.lit(0.0)).when(F.col(value) >= previous, F.col(value) - previous)
    stepped = series.withColumn("_step", step.otherwise(F.col(value)))
    w = by_time.rangeBetween(-(window - 1), 0)
    return (
        stepped.withColumn("increase", F.sum("_step").over(w))
        .withColumn("rate", F.col("increase") / F.lit(float(window)))
        .drop("_step")
    )


def failure_ratio(
    df: DataFrame, failed: Column, keys: Sequence[str] = (), step: str = "5 minutes", ts: str = "timestamp"
) -> DataFrame:
    """Percentage of failed events per key and step."""
    grouped = df.groupBy(*keys, F.window(ts, step).alias("w")).agg(
        F.count_if(failed).alias("failures"), F.count(F.lit(1)).alias("total")
    )
    return grouped.select(
        *keys,
        F.col("w.start").alias("bucket"),
        "failures",
        "total",
        (F.col("failures") / F.col("total") * 100).alias("failure_percent"),
    )


def holds_for(
    series: DataFrame, keys: Sequence[str], firing: Column, seconds: int, at: str = "at"
) -> DataFrame:
    """Points at which a condition has held at every sample of the last ``seconds``.

    The series must reach back that far; a younger one is still pending.
    """
    by_time = Window.partitionBy(*keys).orderBy(at)
    w = by_time.rangeBetween(-seconds, 0)
    flagged = series.withColumn("_on", firing.cast("int"))
    held = flagged.withColumn("_min", F.min("_on").over(w)).withColumn(
        "_first", F.min(at).over(Window.partitionBy(*keys))
    )
    mature = F.col(at) - F.col("_first") >= seconds
    return held.withColumn("firing", (F.col("_min") == 1) & mature).drop("_on", "_min", "_first")


def metric_snapshot(
    df: DataFrame,
    duration: str,
    *,
    counters: dict[str, Column],
    gauges: dict[str, Column],
    histogram_name: str = "query_duration_ms",
) -> DataFrame:
    """Counters, gauges and histogram statistics of a table as (name, type, value) rows, in one pass.

    ``counters`` and ``gauges`` are aggregate columns by metric name.
    """
    scalars = {**counters, **gauges}
    wide = df.agg(*[c.cast("double").alias(n) for n, c in scalars.items()], *_histogram_aggregates(F.col(duration), BUCKETS))
    names = ("count", "sum", "avg", "min", "max", *PERCENTILES)
    stats = [c.cast("double").alias(f"{histogram_name}_{n}") for n, c in zip(names, _histogram_columns(BUCKETS))]
    wide = wide.select(*scalars, *stats)
    kinds = {n: "counter" if n in counters else "gauge" for n in wide.columns}
    pairs = ", ".join(f"'{n}', '{kind}', `{n}`" for n, kind in kinds.items())
    return wide.selectExpr(f"stack({len(kinds)}, {pairs}) as (name, type, value)")


def health(metrics: DataFrame, slow_ms: float = 5000.0) -> DataFrame:
    """Component health from (name, value) metrics: ingestion and query engine."""

    def value(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0)).alias(name)

    wide = metrics.agg(value("total_logs_ingested"), value("query_duration_ms_p99"))
    idle = F.col("total_logs_ingested") == 0
    slow = F.col("query_duration_ms_p99") > slow_ms

    def row(component: str, bad: Column, text: str) -> Column:
        return F.struct(
            F.lit(component).alias("component"),
            F.when(bad, F.lit("degraded")).otherwise(F.lit("ok")).alias("status"),
            F.when(bad, F.lit(text)).otherwise(F.lit("")).alias("message"),
        )

    rows = F.array(
        row("ingestion", idle, "No logs have been ingested"),
        row("query_engine", slow, "Query performance is degraded"),
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")
