"""Streaming twins: sources, tail, enrichment, stateful aggregates and sinks.

Stateless steps are the batch operators applied to a streaming DataFrame. State
is always keyed and bounded by a watermark.
"""

from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ridgelog.functions.positions import numbered
from ridgelog.functions.scalars import ntz, start_of_hour
from ridgelog.operators.errors import with_detected_errors, with_hits
from ridgelog.operators.filters import tail_condition, time_filter
from ridgelog.operators.rollups import latest_per_key, merge_rollups, service_hourly
from ridgelog.operators.traces import _failed, _traced, with_trace_ids
from ridgelog.session import folder_system, scratch_path, state_on_disk

TAIL_BATCH = 100


def stream_files(
    spark: SparkSession, path: str, schema: StructType, *, glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def watermarked(logs: DataFrame, delay: str) -> DataFrame:
    """Logs with a watermark. Event time needs a zoned type; in UTC the cast keeps the value."""
    return logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def _plain(name: str, alias: str | None = None) -> Column:
    """Event time back as a zone-free timestamp."""
    return F.col(name).cast("timestamp_ntz").alias(alias or name.split(".")[-1])


def tail_view(logs: DataFrame, *more: str) -> DataFrame:
    """The columns of a live tail, behind ``more``; the time is its id."""
    return logs.select(
        *more,
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("id"),
        "timestamp",
        "level",
        "service",
        "message",
        "trace_id",
    )


def tail_rows(logs: DataFrame, since, after_id: str | None = None, limit: int = TAIL_BATCH) -> DataFrame:
    """The oldest ``limit`` logs after the cursor (time, id) in the order of both.

    Without ``after_id`` the poll starts behind ``since``. The next cursor is the time and id
    of the last row, so logs that share a time are all delivered, however many.
    """
    newer, at = time_filter(logs, since, None), F.col("timestamp")
    behind = at > ntz(since)
    if after_id is not None:
        behind = behind | ((at == ntz(since)) & (F.col("id") > after_id))
    return newer.filter(behind).orderBy("timestamp", "id").limit(limit)


def tail_batch(logs: DataFrame, since, limit: int = TAIL_BATCH, after_id: str | None = None) -> DataFrame:
    """One poll of a live tail. On a stream the checkpoint replaces the cursor."""
    return tail_view(tail_rows(logs, since, after_id, limit))


def tail_pages(logs: DataFrame, since, limit: int = TAIL_BATCH) -> Iterator[DataFrame]:
    """Polls until nothing is left; only the cursor of each page reaches the driver."""
    after_id = None
    while True:
        page = tail_rows(logs, since, after_id, limit)
        last = page.agg(F.max(F.struct("timestamp", "id")).alias("last")).first()["last"]
        if last is None:
            return
        yield page
        since, after_id = last["timestamp"], last["id"]


def tail_replay(logs: DataFrame, since, limit: int = TAIL_BATCH) -> DataFrame:
    """All polls of ``tail_pages`` at once: the logs after ``since`` with the number of their ``page``, from 0.

    A poll scans the table again; here the rows are ranged by the cursor (time, id) once, so a replay of a long stretch is one
    distributed job and no task or driver sees more than its range.
    """
    rows = numbered(time_filter(logs, since, None).filter(F.col("timestamp") > ntz(since)), ["timestamp", "id"], "page")
    return rows.withColumn("page", F.floor(F.col("page") / limit))


def tail_stream(logs: DataFrame, filters: Iterable[Mapping[str, str]] = ()) -> DataFrame:
    """Live tail of one client: its filters on the stream, then the tail columns."""
    return tail_view(logs.filter(tail_condition(filters)))


def enrich(logs: DataFrame) -> DataFrame:
    """Trace ids and error tags; stateless, for batch and stream."""
    return with_detected_errors(with_trace_ids(logs))


def deduplicate(logs: DataFrame, delay: str = "10 minutes", keys: Sequence[str] = ("id",)) -> DataFrame:
    """Drop repeated deliveries that arrive within the watermark delay."""
    unique = watermarked(logs, delay).dropDuplicatesWithinWatermark(list(keys))
    return unique.withColumn("timestamp", _plain("timestamp"))


def trace_state(logs: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Trace activity, emitted once a trace has been idle for ``gap``.

    The state of a trace is four numbers and its distinct services and spans.
    """
    rows = _traced(logs).select("trace_id", "span_id", "service", "timestamp", _failed().cast("bigint").alias("failed"))
    sessions = (
        watermarked(rows, delay)
        .groupBy("trace_id", F.session_window("timestamp", gap).alias("w"))
        .agg(
            F.min("timestamp").alias("first_log"),
            F.max("timestamp").alias("last_log"),
            F.count(F.lit(1)).alias("log_count"),
            F.sum("failed").alias("error_count"),
            F.array_sort(F.array_remove(F.collect_set("service"), "")).alias("services"),
            F.size(F.array_remove(F.collect_set("span_id"), "")).cast("bigint").alias("span_count"),
        )
    )
    duration = (F.unix_millis("last_log") - F.unix_millis("first_log")).alias("duration_ms")
    return sessions.select(
        "trace_id", _plain("first_log"), _plain("last_log"), "log_count", "error_count", "services", "span_count", duration
    )


def error_state(logs: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Error counts per window, category and pattern; state ends with the watermark."""
    hits = with_hits(watermarked(logs, delay), "timestamp")
    grouped = hits.groupBy(F.window("timestamp", window).alias("w"), "category", "pattern").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    return grouped.select(
        _plain("w.start", "window_start"), "category", "pattern", "count", _plain("first_seen"), _plain("last_seen")
    )


def rate_state(
    logs: DataFrame, keys: Sequence[str] = (), window: int = 60, slide: int = 1, delay: str = "10 minutes"
) -> DataFrame:
    """Sliding rate per second. Seconds are counted first, so a row is not copied to every window."""
    seconds = (
        watermarked(logs, delay)
        .groupBy(*keys, F.window("timestamp", f"{slide} seconds").alias("s"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    at = F.window_time("s")
    sliding = seconds.withColumn("at", at).groupBy(*keys, F.window("at", f"{window} seconds", f"{slide} seconds").alias("w"))
    summed = sliding.agg(F.sum("events").alias("events"))
    return summed.select(
        *keys,
        _plain("w.end", "window_end"),
        "events",
        (F.col("events") / F.lit(float(window))).alias("rate"),
    )


def window_counts(
    logs: DataFrame, keys: Sequence[str], window: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Rows per window and key (the bulk summary and the hourly rollup on a stream)."""
    grouped = (
        watermarked(logs, delay)
        .groupBy(F.window("timestamp", window).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return grouped.select(_plain("w.start", "window_start"), *keys, "count")


def append_sink(
    logs: DataFrame, path: str, checkpoint: str, *, trigger: Mapping[str, object] | None = None
) -> StreamingQuery:
    """Append all logs to a landing table, every few seconds.

    No watermark stands before the sink, so a log is kept however late it comes.
    The sink's own log makes a repeated batch invisible. The landing table is
    folded day by day into the stored table by ``storage.table.publish_days``,
    which removes repeated deliveries by id and turns the many small files into few.
    """
    from ridgelog.storage.table import with_derived

    writer = (
        with_derived(logs)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .partitionBy("date_partition")
    )
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def totals_sink(
    updates: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    sums: Sequence[str],
    minima: Sequence[str] = (),
    maxima: Sequence[str] = (),
    *,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Fold every micro-batch into running totals.

    Version n of the totals is written to its own folder from version n - 1 and
    the batch, so a repeated batch recomputes the same version: no total is
    counted twice. The last two versions are kept, the older one for that case.
    """
    columns = [*keys, *sums, *minima, *maxima]

    def fold(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in sums],
            *[F.min(c).alias(c) for c in minima],
            *[F.max(c).alias(c) for c in maxima],
        )
        if batch_id > 0:
            old = batch.sparkSession.read.parquet(f"{path}/version={batch_id - 1}")
            part = merge_rollups(old.select(*columns), part.select(*columns), keys, sums, minima, maxima)
        part.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        spark = batch.sparkSession
        for version in _versions(spark, path):
            if version < batch_id - 1:
                system, folder = folder_system(spark, f"{path}/version={version}")
                system.delete(folder, True)

    return (
        updates.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(fold)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of totals, by the names of their folders; a half-written one has no _SUCCESS."""
    system, root = folder_system(spark, path)
    found = []
    for entry in system.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("version=") and system.exists(folder_system(spark, f"{path}/{name}/_SUCCESS")[1]):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the totals."""
    versions = _versions(spark, path)
    if not versions:
        raise ValueError(f"no complete version of totals in {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


_LANDED = "id string, timestamp timestamp_ntz, service string, level string, trace_id string, day date, batch bigint"


def service_hourly_sink(logs: DataFrame, landing: str, path: str, checkpoint: str, *, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Keep the exact hourly rollup (``service_hourly``, distinct traces included) of a stream, however late logs come.

    Distinct traces cannot be added up, so every micro-batch lands the columns that the rollup needs, by day and batch, and
    computes the hours it touched anew from all rows landed for them; other hours are neither read nor written.
    Only the days of the batch are listed and scanned. Both writes replace
    whole partitions with what follows from the landed rows alone, so a repeated or half-done batch changes nothing. A
    log that is delivered again counts once within its hour, in its last version. Logs without a timestamp are an hour of their own.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark, named = batch.sparkSession, _LANDED.replace(",", "").split()[::2]
        day = F.to_date("timestamp").alias("day")
        rows = batch.select(*named[:5], day, F.lit(batch_id).cast("bigint").alias("batch"))
        rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(landing)
        days = [r["day"] for r in rows.select("day").distinct().collect()]
        if not days:
            return
        folders = [f"{landing}/day={'__HIVE_DEFAULT_PARTITION__' if d is None else d}" for d in days]
        landed = spark.read.schema(_LANDED).option("basePath", landing).parquet(*folders).withColumn("hour", start_of_hour("timestamp"))
        touched = landed.filter(F.col("batch") == batch_id).select(F.col("hour").alias("touched")).distinct()
        again = landed.join(touched, F.col("hour").eqNullSafe(F.col("touched")), "left_semi")
        again = latest_per_key(again, ["hour", "id"], ["batch", "timestamp", "service", "level", "trace_id"])
        hourly = service_hourly(again).withColumns({"day": F.to_date("hour"), "at": F.hour("hour")})
        hourly.hint("rebalance", "day", "at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "at").parquet(path)

    return logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def landed_service_hourly(spark: SparkSession, path: str) -> DataFrame:
    """The rollup that ``service_hourly_sink`` keeps."""
    schema = "hour timestamp_ntz, service string, level string, count bigint, unique_traces bigint, day date, at int"
    return spark.read.schema(schema).parquet(path).drop("day", "at")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and are missing in a query's windows or sessions, so far as it remembers.

    The batch twin over the stored table counts them.
    """
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def run_available(stream: DataFrame, label: str, *, state_machine: bool = False) -> DataFrame:
    """Drain a stream into a table in the shared folder and read the table back.

    A stream with a ``state_machine`` (``transformWithState``) is started with the one state store that can hold it.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with state_on_disk(spark) if state_machine else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
