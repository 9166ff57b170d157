"""Batched delivery of a stream: flush by size or time, retries with back-off, a ledger of batches and a place for those that fail."""

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ridgelog.session import folder_system

#: how often a batch is tried, and the seconds before the second attempt; the wait doubles from one attempt to the next
ATTEMPTS, BACKOFF = 3, 1.0
_LEDGER = "state string, attempts int, error string, batch bigint"
DELIVERED, QUARANTINED = "delivered", "quarantined"

Write = Callable[[DataFrame, int], None]


def files_by_size(spark: SparkSession, path: str, schema: StructType, most_bytes: int) -> DataFrame:
    """Parquet files of a folder as a stream whose micro-batches take files of about ``most_bytes`` bytes in all, one file at least."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(most_bytes)).parquet(path)


def landing_writer(path: str) -> Write:
    """Writes a batch to the landing rows of a delivery, by day and batch.

    The partitions of a batch follow from its rows, so a further attempt
    replaces exactly what an earlier one left. One file a day and batch, if AQE
    finds the day small.
    """
    from ridgelog.storage.table import with_derived

    def write(rows: DataFrame, batch: int) -> None:
        marked = with_derived(rows).withColumn("batch", F.lit(batch).cast("bigint")).hint("rebalance", "date_partition")
        writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy("date_partition", "batch").parquet(f"{path}/rows")

    return write


def delivering_sink(
    logs: DataFrame,
    path: str,
    checkpoint: str,
    *,
    write: Write | None = None,
    attempts: int = ATTEMPTS,
    backoff: float = BACKOFF,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Deliver every micro-batch by ``write(rows, batch)``: to the landing rows below ``path``, or to a sink of the caller's.

    A failing batch is tried ``attempts`` times in all, with doubling waits. After the last
    one its rows go to the quarantine below ``path`` and the stream goes on;
    ``redeliver`` tries them again. The ledger has one entry for every batch, written
    after its rows, and a batch with an entry is not delivered again when the driver
    was lost before Spark noted it. A sink of the caller's may see one batch
    twice if the driver is lost between its write and the entry; the number
    tells. If even the quarantine cannot be written the query fails, and
    a restart begins with the same batch: nothing is lost.
    """
    write = write or landing_writer(path)

    def deliver(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if _entered(spark, path, batch):
            return
        tried, error = _attempt(lambda: write(rows, batch), attempts, backoff)
        if error:
            rows.write.mode("overwrite").parquet(f"{path}/quarantine/batch={batch}")
        _enter(spark, path, batch, QUARANTINED if error else DELIVERED, tried, error)

    stream = logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return stream.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def _attempt(action: Callable[[], None], attempts: int, backoff: float) -> tuple[int, str]:
    """How often the action was tried, and the last error; '' if it succeeded."""
    error = ""
    for k in range(attempts):
        if k:
            time.sleep(backoff * 2 ** (k - 1))
        try:
            action()
            return k + 1, ""
        except Exception as problem:  # noqa: BLE001 - whatever a sink raises, the batch is tried again or set aside
            lines = str(problem).splitlines()
            error = f"{type(problem).__name__}: {lines[0] if lines else ''}"[:500]
    return attempts, error


def _entered(spark: SparkSession, path: str, batch: int) -> bool:
    system, entry = folder_system(spark, f"{path}/ledger/batch={batch}/_SUCCESS")
    return system.exists(entry)


def _enter(spark: SparkSession, path: str, batch: int, state: str, attempts: int, error: str) -> None:
    entry = spark.range(1, numPartitions=1).select(F.lit(state).alias("state"), F.lit(attempts).alias("attempts"), F.lit(error).alias("error"))
    entry.write.mode("overwrite").json(f"{path}/ledger/batch={batch}")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``(state, attempts, error, batch)`` for every batch that was delivered or set aside."""
    system, root = folder_system(spark, f"{path}/ledger")
    if not system.exists(root):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).json(f"{path}/ledger")


def delivered_rows(spark: SparkSession, path: str) -> DataFrame:
    """The landed rows of the delivered batches, with ``batch``.

    What a broken attempt left of a batch that is not in the ledger, or is in
    quarantine, is not seen: those partitions are left out by the batch's folder.
    """
    rows = spark.read.parquet(f"{path}/rows")
    return rows.join(ledger(spark, path).filter(F.col("state") == DELIVERED).select("batch"), "batch", "left_semi")


def quarantined_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the batches that are set aside, with ``batch``; ``schema`` is that of the stream."""
    system, root = folder_system(spark, f"{path}/quarantine")
    wide = StructType([*schema.fields, StructField("batch", LongType())])
    if not system.exists(root):
        return spark.createDataFrame([], wide)
    rows = spark.read.schema(wide).parquet(f"{path}/quarantine")
    return rows.join(ledger(spark, path).filter(F.col("state") == QUARANTINED).select("batch"), "batch", "left_semi")


def redeliver(spark: SparkSession, path: str, *, write: Write | None = None, attempts: int = ATTEMPTS, backoff: float = BACKOFF) -> int:
    """Try the batches in quarantine again; returns how many were delivered.

    One batch at a time, under its own number, so a repeated run replaces what it left. A batch that fails
    again stays, with the new error and all its attempts in the ledger. Its folder stays too, and is no
    longer read once the ledger says delivered.
    """
    write, done = write or landing_writer(path), 0
    waiting = ledger(spark, path).filter(F.col("state") == QUARANTINED).orderBy("batch")
    for entry in waiting.toLocalIterator():
        rows = spark.read.parquet(f"{path}/quarantine/batch={entry.batch}")
        tried, error = _attempt(lambda: write(rows, entry.batch), attempts, backoff)  # noqa: B023 - called at once
        _enter(spark, path, entry.batch, QUARANTINED if error else DELIVERED, entry.attempts + tried, error)
        done += not error
    return done
