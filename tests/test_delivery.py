"""Delivery with retries: what fails is tried again or set aside, and nothing is lost or doubled."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgelog.schema import LOG_SCHEMA
from ridgelog.session import scratch_path
from ridgelog.storage.table import publish_days, read_logs
from ridgelog.streaming import delivery as d

NOW = {"availableNow": True}


@pytest.fixture
def arriving(spark, make_logs):
    """Four files of five logs; one of each file has no time."""
    path = scratch_path(spark, "arriving")
    for k in range(4):
        rows = [{"id": f"{k}-{i}", "timestamp": None if i == 4 else datetime(2024, 1, 5) + timedelta(days=k, hours=9 * i)} for i in range(5)]
        make_logs(rows).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(spark, source, path, checkpoint, write=None, **more):
    stream = d.files_by_size(spark, source, LOG_SCHEMA, 1)
    d.delivering_sink(stream, path, checkpoint, write=write, backoff=0, trigger=NOW, **more).awaitTermination()


def breaking(path, fails):
    """Writes half of a batch and fails, as often as ``fails`` says for the batch."""
    calls, write = {}, d.landing_writer(path)

    def broken(rows, batch):
        calls[batch] = calls.get(batch, 0) + 1
        if calls[batch] <= fails.get(batch, 0):
            write(rows.filter("id LIKE '%0' OR id LIKE '%4'"), batch)
            raise OSError(f"sink away\nin batch {batch}")
        write(rows, batch)

    return broken, calls


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


def test_two_failures_lose_and_double_nothing(spark, arriving):
    path, checkpoint = scratch_path(spark, "delivery"), scratch_path(spark, "checkpoint")
    write, calls = breaking(path, {1: 2, 2: 1})
    drain(spark, arriving, path, checkpoint, write)
    assert calls == {0: 1, 1: 3, 2: 2, 3: 1}
    assert ids(d.delivered_rows(spark, path)) == ids(spark.read.parquet(arriving))
    assert {(r.batch, r.state, r.attempts) for r in d.ledger(spark, path).collect()} == {(0, "delivered", 1), (1, "delivered", 3), (2, "delivered", 2), (3, "delivered", 1)}
    assert d.quarantined_rows(spark, path, LOG_SCHEMA).count() == 0


def test_a_batch_that_keeps_failing_is_set_aside_and_redelivered(spark, arriving):
    path, checkpoint = scratch_path(spark, "delivery"), scratch_path(spark, "checkpoint")
    write, calls = breaking(path, {1: 5})
    drain(spark, arriving, path, checkpoint, write)
    held = d.quarantined_rows(spark, path, LOG_SCHEMA)
    assert calls[1] == 3 and held.count() == 5 and {r.batch for r in held.collect()} == {1}
    # the half that the broken attempts left is not seen
    assert d.delivered_rows(spark, path).filter("batch = 1").count() == 0
    entry = d.ledger(spark, path).filter("batch = 1").first()
    assert (entry.state, entry.attempts, entry.error) == ("quarantined", 3, "OSError: sink away")
    assert d.redeliver(spark, path, write=write, attempts=1, backoff=0) == 0
    assert d.redeliver(spark, path, write=write, attempts=2, backoff=0) == 1
    assert ids(d.delivered_rows(spark, path)) == ids(spark.read.parquet(arriving))
    assert d.quarantined_rows(spark, path, LOG_SCHEMA).count() == 0 and d.ledger(spark, path).filter("batch = 1").first().attempts == 6
    assert d.redeliver(spark, path) == 0


def test_a_lost_driver_does_not_deliver_again(spark, arriving):
    """Spark has not noted the batches (a new checkpoint), the ledger has."""
    path = scratch_path(spark, "delivery")
    write, calls = breaking(path, {})
    drain(spark, arriving, path, scratch_path(spark, "checkpoint"), write)
    drain(spark, arriving, path, scratch_path(spark, "checkpoint"), write)
    assert set(calls.values()) == {1} and ids(d.delivered_rows(spark, path)) == ids(spark.read.parquet(arriving))


def test_the_landed_rows_are_published_and_an_unusable_quarantine_ends_the_query(spark, arriving):
    path = scratch_path(spark, "delivery")
    drain(spark, arriving, path, scratch_path(spark, "checkpoint"))
    table = scratch_path(spark, "table")
    days = [r[0] for r in read_logs(spark, f"{path}/rows").select("date_partition").distinct().collect()]
    publish_days(spark, f"{path}/rows", table, days)
    assert ids(read_logs(spark, table)) == ids(spark.read.parquet(arriving))

    other = scratch_path(spark, "delivery")
    away, _ = breaking(other, {0: 99})
    with pytest.raises(Exception, match="quarantine"):
        stream = d.files_by_size(spark, arriving, LOG_SCHEMA, 1).withColumn("level", F.raise_error(F.lit("quarantine cannot be read")).cast("string"))
        d.delivering_sink(stream, other, scratch_path(spark, "checkpoint"), write=away, backoff=0, trigger=NOW).awaitTermination()
    assert d.ledger(spark, other).count() == 0


def test_batches_are_admitted_by_bytes(spark, arriving):
    path = scratch_path(spark, "delivery")
    stream = d.files_by_size(spark, arriving, LOG_SCHEMA, 1 << 30)
    d.delivering_sink(stream, path, scratch_path(spark, "checkpoint"), trigger=NOW).awaitTermination()
    assert [r.batch for r in d.ledger(spark, path).collect()] == [0]


def test_an_empty_folder_delivers_nothing(spark, make_logs):
    source, path = scratch_path(spark, "arriving"), scratch_path(spark, "delivery")
    make_logs([]).write.parquet(source)
    drain(spark, source, path, scratch_path(spark, "checkpoint"))
    assert d.quarantined_rows(spark, path, LOG_SCHEMA).count() == 0
