"""Materialised rollups and the merging of their partial states."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelog.functions.scalars import start_of_hour
from ridgelog.schema import FAILURE_LEVELS


def service_hourly(df: DataFrame) -> DataFrame:
    """Rows and distinct traces per hour, service and level.

    Distinct traces are recomputed from the logs of an hour, never added up.
    """
    return df.groupBy(start_of_hour("timestamp").alias("hour"), "service", "level").agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("trace_id").alias("unique_traces")
    )


def errors_daily(df: DataFrame) -> DataFrame:
    """Errors, warnings and rows per day and service."""
    return df.groupBy(F.to_date("timestamp").alias("day"), "service").agg(
        F.count_if(F.col("level").isin(*FAILURE_LEVELS)).alias("error_count"),
        F.count_if(F.col("level") == "warn").alias("warn_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def trace_rollup(df: DataFrame) -> DataFrame:
    """Bounds, rows, services and errors per stored trace id.

    ``service_rows`` lists every service with its rows: the array of all
    services of a trace in run-length form.
    """
    per_service = (
        df.filter(F.col("trace_id") != "")
        .groupBy("trace_id", "service")
        .agg(
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("level").isin(*FAILURE_LEVELS)).alias("errors"),
        )
    )
    return per_service.groupBy("trace_id").agg(
        F.min("first").alias("start_time"),
        F.max("last").alias("end_time"),
        F.sum("rows").alias("span_count"),
        F.count(F.lit(1)).alias("service_count"),
        F.sum("errors").alias("error_count"),
        F.sort_array(F.collect_list(F.struct("service", "rows"))).alias("service_rows"),
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest version of every key.

    An aggregate rather than a window: versions of a hot key are reduced on the
    map side and never sorted in one task. Only ``version`` is compared, so the other
    columns may have any type; rows of equal versions are equally new.
    """
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*version))
    return df.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*").select(*df.columns)


def merge_rollups(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str],
    minima: Sequence[str] = (),
    maxima: Sequence[str] = (),
) -> DataFrame:
    """Fold a new batch into a stored rollup; additive and min/max columns only."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in minima],
        *[F.max(c).alias(c) for c in maxima],
    )


#: size of the sketches: 2^12 registers (standard error 1.04 / 64 = 1.6 %), and a rank error of about 1.3 %
LG_REGISTERS = 12
KLL_K = 200


def sketch_rollup(df: DataFrame, keys: Sequence[str] = ("service", "level"), lg_registers: int = LG_REGISTERS, k: int = KLL_K) -> DataFrame:
    """Rows per hour and ``keys`` with a sketch of the distinct traces and one of the message lengths.

    Unlike the exact numbers of ``service_hourly``, these can be united to days and months (``merge_sketches``)
    without the logs. A sketch has a fixed size, so a hot group needs no more memory than a small one. As in the exact
    rollup the empty trace id counts as one, and a null one as none; a group without messages has a null length sketch.
    """
    trace = F.when(F.col("trace_id").isNotNull(), F.xxhash64("trace_id"))  # a sketch of texts would leave out the empty one
    return df.groupBy(start_of_hour("timestamp").alias("hour"), *keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.hll_sketch_agg(trace, lg_registers).alias("traces"),
        F.kll_sketch_agg_bigint(F.octet_length("message").cast("bigint"), k).alias("lengths"),
    )


def merge_sketches(rollup: DataFrame, *keys: str | Column) -> DataFrame:
    """The rollup united to coarser ``keys``, such as a day or month of its ``hour``; the result can be merged again."""
    return rollup.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.hll_union_agg("traces").alias("traces"), F.kll_merge_agg_bigint("lengths").alias("lengths")
    )


def sketch_estimates(rollup: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """``unique_traces`` and the length quantiles ``p50``, ``p95`` ... that the sketches of a rollup stand for."""
    found = {"unique_traces": F.hll_sketch_estimate("traces")}
    for q in quantiles:
        found[f"p{q * 100:g}"] = F.kll_sketch_get_quantile_bigint("lengths", F.lit(float(q)))
    return rollup.withColumns(found).drop("traces", "lengths")
