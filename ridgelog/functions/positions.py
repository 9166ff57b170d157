"""Gapless positions of rows in a global order, without a task that sees all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.session import checkpointed

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the place in the task in so many bits


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with its position from 0 in the order of the columns ``order``.

    Rows are dealt out by range, sorted within their task and stored with their place
    there. One count per task goes through the driver and comes back as the first
    position of the task. Equal rows are numbered in any order, but once and for all.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed, "numbered")
    task, place = F.shiftright("_at", _LOCAL_BITS), F.col("_at").bitwiseAND((1 << _LOCAL_BITS) - 1)
    counts = sorted((r["task"], r["count"]) for r in placed.groupBy(task.alias("task")).count().collect())
    starts, done = [], 0
    for k, n in counts:
        starts.append((int(k), done))
        done += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_task bigint, _start bigint"))
    return placed.join(offsets, task == F.col("_task")).withColumn(name, place + F.col("_start")).drop("_at", "_task", "_start")
