"""The stored ``logs`` table: layout, derived columns, retention, compaction.

A table's partition columns tell its interval, so the jobs find the layout in the
table itself: ``date_partition`` (daily), with ``hour_partition`` below it (hourly),
``week_partition`` or ``month_partition``.
"""

import calendar
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelog.functions.scalars import epoch_millis, level_rank, ntz, partition_key, start_of_hour
from ridgelog.operators.filters import time_filter
from ridgelog.operators.rollups import latest_per_key
from ridgelog.session import checkpointed, folder_system

HOT_DAYS = 7
RETENTION_DAYS = 30
COMPACT_PER_RUN = 10
MAX_ROWS_PER_FILE = 20_000_000
SORT_ORDER = ("service", "level_numeric", "timestamp")

#: partition columns by interval; any other interval is daily
PARTITIONS = {
    "daily": ("date_partition",),
    "hourly": ("date_partition", "hour_partition"),
    "weekly": ("week_partition",),
    "monthly": ("month_partition",),
}
#: the name of the folder that holds rows without a timestamp
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
_DERIVED = ("date_partition", "hour_partition", "level_numeric", "week_partition", "month_partition")

# fixed values: codec names and the Parquet codec that stands for them
PARQUET_CODEC = {"ZSTD": "zstd", "LZ4": "lz4_raw", "LZ4HC": "lz4_raw", "SNAPPY": "snappy", "NONE": "none"}
ZSTD_LEVEL = 3


def with_derived(df: DataFrame) -> DataFrame:
    """Millisecond timestamps, text attributes and the derived columns of the table."""
    millis = F.timestamp_millis(epoch_millis("timestamp")).cast("timestamp_ntz")
    return df.withColumn("timestamp", millis).withColumns(
        {
            "attributes": F.transform_values("attributes", lambda _, v: v.cast("string")),
            "date_partition": F.to_date("timestamp"),
            "hour_partition": F.hour("timestamp"),
            "level_numeric": level_rank("level"),
        }
    )


def with_hour_and_day(df: DataFrame) -> DataFrame:
    """Derived columns of the alternative layout: start of the hour, and the day."""
    return df.withColumns({"hour": start_of_hour("timestamp"), "day": F.to_date("timestamp")})


def partition_columns(interval: str) -> tuple[str, ...]:
    return PARTITIONS.get(interval, PARTITIONS["daily"])


def _folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(column, value)`` of the partition folders right below a table; names only, no data."""
    system, root = folder_system(spark, path)
    names = [entry.getPath().getName() for entry in system.listStatus(root)]
    return sorted(tuple(n.split("=", 1)) for n in names if "=" in n and not n.startswith(("_", ".")))


def stored_interval(spark: SparkSession, path: str) -> str:
    """The interval of a stored table, from the names of its folders."""
    columns = {c for c, _ in _folders(spark, path)}
    if columns == {"date_partition"}:
        day = next(v for _, v in _folders(spark, path))
        return "hourly" if _folders(spark, f"{path}/date_partition={day}") else "daily"
    for interval in ("weekly", "monthly"):
        if columns == set(PARTITIONS[interval]):
            return interval
    raise ValueError(f"not a stored table of logs: {path} has partitions by {sorted(columns)}")


def last_day(value: str, interval: str) -> date | None:
    """The last day whose rows a partition may hold; None for the partition without timestamps."""
    if value == NULL_PARTITION:
        return None
    if interval == "weekly":
        return date.fromisocalendar(int(value[:4]), int(value[4:]), 7)
    if interval == "monthly":
        year, month = int(value[:4]), int(value[4:])
        return date(year, month, calendar.monthrange(year, month)[1])
    return date.fromisoformat(value)


def _last_day_column(df: DataFrame) -> Column:
    """The same for the partition column of a frame."""
    if "week_partition" in df.columns:
        value = F.col("week_partition").cast("string")
        fourth = F.make_date(F.left(value, F.lit(4)).cast("int"), F.lit(1), F.lit(4))
        return F.date_add(F.trunc(fourth, "week"), F.right(value, F.lit(2)).cast("int") * 7 - 1)
    if "month_partition" in df.columns:
        return F.last_day(F.to_date(F.col("month_partition").cast("string"), "yyyyMM"))
    return F.col("date_partition")


def codec_options(codec: str = "ZSTD", level: int | None = None) -> dict[str, str]:
    """Writer options of a codec; an unknown one means ZSTD."""
    parquet = PARQUET_CODEC.get(codec.upper(), "zstd")
    options = {"compression": parquet}
    if parquet == "zstd":
        options["parquet.compression.codec.zstd.level"] = str(level or ZSTD_LEVEL)
    return options


def write_logs(
    df: DataFrame,
    path: str,
    *,
    interval: str = "daily",
    codec: str = "ZSTD",
    level: int | None = None,
    mode: str = "append",
    cluster: bool = False,
    sort: tuple[str, ...] = SORT_ORDER,
) -> None:
    """Write logs as a partitioned, sorted Parquet table.

    Rows are gathered by partition with a rebalance: AQE splits a hot day over
    many tasks and joins small ones, so file sizes stay even. ``cluster`` ranges
    rows by the whole sort key instead, which costs a sampling pass and gives
    files with disjoint key ranges; compaction uses it. ``append`` adds,
    ``overwrite`` replaces only the partitions that occur in ``df``.
    """
    rows = with_derived(df)
    parts = partition_columns(interval)
    if interval in ("weekly", "monthly"):
        rows = rows.withColumn(parts[0], partition_key("timestamp", interval))
    if cluster:
        rows = rows.repartitionByRange(*parts, *sort)
    else:
        rows = rows.hint("rebalance", *parts)
    (
        rows.sortWithinPartitions(*parts, *sort)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .options(**codec_options(codec, level))
        .partitionBy(*parts)
        .parquet(path)
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def age_days(day, as_of: datetime) -> Column:
    return F.datediff(F.lit(as_of.date()), day)


def tier(ts, as_of: datetime, hot_days: int = HOT_DAYS, keep_days: int = RETENTION_DAYS) -> Column:
    """hot, cold or expired by the age of the row."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.when(ts <= ntz(as_of - timedelta(days=keep_days)), F.lit("expired"))
        .when(ts <= ntz(as_of - timedelta(days=hot_days)), F.lit("cold"))
        .otherwise(F.lit("hot"))
    )


def tier_counts(df: DataFrame, as_of: datetime, hot_days: int = HOT_DAYS, keep_days: int = RETENTION_DAYS):
    """Rows per day and tier."""
    return df.groupBy(
        F.to_date("timestamp").alias("day"), tier("timestamp", as_of, hot_days, keep_days).alias("tier")
    ).agg(F.count(F.lit(1)).alias("row_count"))


def retained(df: DataFrame, as_of: datetime, keep_days: int = RETENTION_DAYS) -> DataFrame:
    """Rows that have not expired."""
    oldest = as_of - timedelta(days=keep_days)
    return time_filter(df, oldest, None).filter(F.col("timestamp") > ntz(oldest))


def expired_days(info: DataFrame, as_of: datetime, keep_days: int = RETENTION_DAYS) -> DataFrame:
    """Partitions whose youngest possible row has expired; any layout. Rows without a timestamp never expire."""
    return info.filter(_last_day_column(info) < F.lit((as_of - timedelta(days=keep_days)).date()))


def drop_expired(spark: SparkSession, path: str, as_of: datetime, keep_days: int = RETENTION_DAYS) -> list[str]:
    """Delete whole expired partitions through the table's file system and return their values.

    Only directory names are listed; no data is read or rewritten. Works on every
    layout; a partition goes when its last day has expired. The partition of rows without a
    timestamp stays.
    """
    interval, (column, *_) = stored_interval(spark, path), PARTITIONS[stored_interval(spark, path)]
    cutoff, dropped = (as_of - timedelta(days=keep_days)).date(), []
    for _, value in _folders(spark, path):
        day = last_day(value, interval)
        if day is not None and day < cutoff:
            system, folder = folder_system(spark, f"{path}/{column}={value}")
            if system.delete(folder, True):
                dropped.append(value)
    return sorted(dropped)


def compaction_candidates(
    info: DataFrame, as_of: datetime, hot_days: int = HOT_DAYS, limit: int = COMPACT_PER_RUN
) -> DataFrame:
    """The oldest partitions past the hot window that consist of several files; any layout."""
    day = _last_day_column(info)
    old = info.filter(day < F.lit((as_of - timedelta(days=hot_days)).date()))
    return old.filter(F.col("parts") > 1).orderBy(day).limit(limit)


def _partitions(rows: DataFrame, column: str, values: Sequence) -> DataFrame:
    """The rows of whole partitions; the value None stands for the rows without a timestamp."""
    named = F.col(column).cast("string").isin([str(v) for v in values if v is not None])
    return rows.filter(named | F.col(column).isNull() if None in values else named)


def _core(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in _DERIVED])


def compact(spark: SparkSession, path: str, partitions: Sequence, **layout) -> None:
    """Rewrite whole partitions, given by their values, into few large, clustered files.

    The layout is that of the table; an ``interval`` that differs is refused. Dynamic
    partition overwrite stages the new files and swaps the partitions
    at commit, so a failed job leaves the old files in place.
    """
    interval = _own_interval(spark, path, layout)
    if partitions:
        rows = _partitions(read_logs(spark, path), PARTITIONS[interval][0], partitions)
        write_logs(_core(rows), path, mode="overwrite", cluster=True, interval=interval, **layout)


def _own_interval(spark: SparkSession, path: str, layout: dict) -> str:
    """The table's interval; takes ``interval`` out of the layout."""
    stored, asked = stored_interval(spark, path), layout.pop("interval", None)
    if asked is not None and partition_columns(asked) != PARTITIONS[stored]:
        raise ValueError(f"the table is {stored}, not {asked}")
    return stored


def publish_days(spark: SparkSession, landing: str, path: str, days: Sequence[date | None], *, moved: bool = True, **layout) -> None:
    """Merge the landed rows of the given days into the stored table.

    The day None stands for landed rows without a timestamp, which have a partition of
    their own. Of landed rows with the same id the latest by time is taken (of equally late
    ones that with the greatest hash of its fields, so that a repeated run publishes the same), and it replaces the stored row of
    that id; every other stored row stays. So running the job again, or later with
    rows that came late, loses and doubles nothing. Whole partitions are rewritten, in the layout of
    the table, or, if there is none yet, in ``interval``.

    An id may be stored in another partition than its landed row belongs to, because its
    time was corrected. Those partitions are found by the table's id column, the only one that is read of
    the whole table, and rewritten too. ``moved=False`` leaves that scan out where times never change.
    """
    if not days:
        return
    system, root = folder_system(spark, path)
    exists = system.exists(root) and bool(_folders(spark, path))
    interval = _own_interval(spark, path, layout) if exists else layout.pop("interval", "daily")
    # stored, as the ids, the partitions and the rows are read one after the other
    landed = checkpointed(_latest_landed(_core(_partitions(read_logs(spark, landing), "date_partition", days))), "latest-landed")
    emptied: list[str] = []
    if exists:
        column = PARTITIONS[interval][0]
        values = set(days) if column == "date_partition" else {d and _period(d, interval) for d in days}
        values = {v if v is None else str(v) for v in values}
        ids = landed.select("id")
        if moved:
            held = read_logs(spark, path).select("id", F.col(column).cast("string").alias("_held"))
            values |= {r["_held"] for r in held.join(ids, "id", "left_semi").select("_held").distinct().collect()}
        stored = _partitions(read_logs(spark, path), column, list(values)).withColumn("_held", F.col(column).cast("string"))
        kept = stored.join(ids, "id", "left_anti")
        if moved:
            # partitions that lose all their rows are not overwritten by what is written
            left = {r["_held"] for r in kept.select("_held").distinct().collect()}
            got = {r["_to"] for r in landed.select(_partition_value("timestamp", interval).alias("_to")).distinct().collect()}
            emptied = sorted(NULL_PARTITION if v is None else v for v in values - left - got)
        landed = landed.unionByName(_core(kept.drop("_held")))
    write_logs(landed, path, mode="overwrite", cluster=True, interval=interval, **layout)
    for value in emptied:
        system, folder = folder_system(spark, f"{path}/{PARTITIONS[interval][0]}={value}")
        system.delete(folder, True)


def _latest_landed(rows: DataFrame) -> DataFrame:
    """One row for every id: the latest, whatever order the rows are read in."""
    plain = [F.to_json(F.map_from_entries(F.sort_array(F.map_entries(c)))) if t.startswith("map") else F.col(c) for c, t in rows.dtypes]
    marked = rows.withColumn("_hash", F.xxhash64(*plain))
    return latest_per_key(marked, ["id"], ["timestamp", "_hash"]).drop("_hash")


def _partition_value(ts: str, interval: str) -> Column:
    """The text of the first partition column of a row."""
    day = F.to_date(F.timestamp_millis(epoch_millis(ts)))
    return (partition_key(ts, interval) if interval in ("weekly", "monthly") else day).cast("string")


def _period(day: date, interval: str) -> str:
    """The value of the weekly or monthly partition of a day."""
    if interval == "weekly":
        year, week, _ = day.isocalendar()
        return f"{year}{week:02d}"
    return f"{day.year}{day.month:02d}"
