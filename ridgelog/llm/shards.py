"""Shards of near-equal bytes: the minimax contiguous partition of ordered groups of equal texts."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgelog.functions.positions import numbered
from ridgelog.session import checkpointed

#: stretches of the whole length whose cut points the driver sees at once
STRETCHES = 8192


@dataclass(frozen=True)
class _Cuts:
    """Known places where a group begins, and for each whether other groups begin before the next known place."""

    places: np.ndarray
    open: np.ndarray

    def floor(self, limit: int) -> tuple[int, int, int]:
        """The last known place up to ``limit``, the last that could lie there, and the number of the gap."""
        k = int(np.searchsorted(self.places, limit, "right")) - 1
        known = int(self.places[k])
        return known, (max(known, limit) if self.open[k] else known), k


def _reaches(cuts: _Cuts, total: int, shards: int, capacity: int, hopeful: bool) -> tuple[bool, list[tuple[int, int]]]:
    """Whether greedy filling gets all groups into the shards, and the start of every shard with the gap it lies in.

    Where a gap is open, the next cut is taken as far as it might lie (hopeful) or only at a known place.
    """
    at, found = 0, []
    for _ in range(shards):
        found.append((at, cuts.floor(at)[2]))
        if at + capacity >= total:
            return True, found
        known, hoped, _ = cuts.floor(at + capacity)
        at = max(at, hoped if hopeful else known)
    return False, found


def _summary(groups: DataFrame, unit: int, begins: int = 0) -> list[tuple[int, int, int]]:
    """First and last start and number of the groups that start in each stretch of ``unit`` bytes, in order."""
    stretch = F.floor((F.col("start") - begins) / unit)
    rows = groups.groupBy(stretch.alias("k")).agg(F.min("start"), F.max("start"), F.count(F.lit(1))).collect()
    return sorted((r[1], r[2], r[3]) for r in rows)


def _cuts(summary: list[tuple[int, int, int]]) -> _Cuts:
    places, open_ = [], []
    for first, last, n in summary:
        places.append(first)
        open_.append(n > 2)
        if last > first:
            places.append(last)
            open_.append(False)
    return _Cuts(np.array(places, np.int64), np.array(open_, bool))


def minimax_starts(groups: DataFrame, total: int, largest: int, shards: int, stretches: int = STRETCHES) -> tuple[int, list[int]]:
    """The smallest capacity with which ``shards`` contiguous shards hold all groups, and the starts of the shards.

    ``groups`` has the place ``start`` (bytes before it) of every group in order. The capacity is
    found by binary search; each trial fills shard after shard greedily. The
    driver holds the first and last start in each of ``stretches`` equal stretches
    of the whole length. While the answer hangs on starts inside a stretch, the stretches in which a
    trial's cuts may lie are looked at in finer stretches, so the driver never holds more
    than a fixed number of places for each stretch that matters, whatever the number of groups.
    """
    if total <= 0:
        return 0, [0] * shards
    unit = max(1, -(-total // stretches))
    summary = _summary(groups, unit)
    low, high = max(largest, -(-total // shards)), total
    while True:
        cuts = _cuts(summary)
        while low < high:
            middle = (low + high) // 2
            if _reaches(cuts, total, shards, middle, False)[0]:
                high = middle
            elif not _reaches(cuts, total, shards, middle, True)[0]:
                low = middle + 1
            else:
                break
        if low == high:
            done, found = _reaches(cuts, total, shards, low, False)
            hoped = _reaches(cuts, total, shards, low, True)[1]
            if done and [a for a, _ in found] == [a for a, _ in hoped]:
                return low, [a for a, _ in found] + [total] * (shards - len(found))
        # every cut of a trial between low and high lies between its places for the two
        least, most = _reaches(cuts, total, shards, low, False)[1], _reaches(cuts, total, shards, high, True)[1]
        touched = {k for (_, a), (_, b) in zip(least, most) for k in range(a, b + 1)} | {k for _, b in most[len(least):] for k in range(least[-1][1], b + 1)}
        touched |= {k for _, a in least[len(most):] for k in range(a, len(cuts.places))}
        gaps = [(int(cuts.places[k]), int(cuts.places[k + 1])) for k in sorted(touched) if cuts.open[k]]
        unit = max(1, unit // 64)
        inside = F.lit(False)
        for begins, ends in _merged(gaps):
            inside = inside | ((F.col("start") > begins) & (F.col("start") < ends))
        summary = sorted(set(summary_known(summary, gaps)) | set(_summary(groups.where(inside), unit)))


def summary_known(summary: list[tuple[int, int, int]], gaps: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The summary with the bounds of the looked-at gaps as places of their own."""
    looked = {a for a, _ in gaps}
    kept = []
    for first, last, n in summary:
        kept += [(first, first, 1), (last, last, 1)] if first in looked and n > 2 else [(first, last, n)]
    return kept


def _merged(gaps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Gaps that touch as one; what lies between them is a known place and may be looked at again."""
    out: list[list[int]] = []
    for begins, ends in sorted(gaps):
        if out and begins <= out[-1][1]:
            out[-1][1] = max(out[-1][1], ends)
        else:
            out.append([begins, ends])
    return [(a, b) for a, b in out]


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    Rows with equal texts are a group and stay in one shard. Groups stand in the
    order of their smallest doc_id (without any: first); shards are contiguous in that order and
    their largest size is the smallest possible; the law is ``bytes``. A size is the UTF-8
    bytes of the text plus 1; a null text has none and groups with null texts only (its crc32 is that of an
    empty text). ``slot`` counts the rows of a shard from 0 by group and doc_id.
    ``grown_shard`` is null under this law. Repeated rows each get a slot; other columns are not read;
    if there are fewer groups than shards, the last shards stay empty.

    A group of any number of rows is one sum while shards are cut; its rows are dealt
    out by range, doc_id included, when they are numbered.
    """
    body = F.col(text).cast("string")
    size = (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long")
    bytes_ = F.coalesce(body, F.lit("")).cast("binary")
    key = F.when(body.isNull(), F.lit("")).otherwise(F.md5(bytes_))
    rows = checkpointed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.crc32(bytes_).alias("text_crc32"), key.alias("key")), "shard-rows")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("n"))
    groups = checkpointed(_with_starts(groups), "shard-groups")
    total, largest = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.coalesce(F.max("group_size"), F.lit(0))).first()
    _, starts = minimax_starts(groups, total, largest, shards)

    shard = sum((F.when(F.col("start") >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0)).cast("int")
    placed = groups.select("key", "first_doc", shard.alias("shard"), "n")
    before = placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()
    begins, done = [], 0
    for r in sorted(before):
        begins.append((r["shard"], done))
        done += r["n"]
    begins = F.broadcast(rows.sparkSession.createDataFrame(begins, "shard int, begins long"))
    joined = rows.join(placed.drop("n"), "key").select("doc_id", "size", "text_crc32", "first_doc", "key", "shard")
    slots = numbered(joined, ["first_doc", "key", "doc_id"]).join(begins, "shard")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("begins")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_starts(groups: DataFrame) -> DataFrame:
    """Groups in the order of ``first_doc`` with ``start``, the bytes before each: sums by task, then one number per task."""
    order = ["first_doc", "key"]
    dealt = checkpointed(groups.repartitionByRange(*order).withColumn("task", F.spark_partition_id()), "shard-dealt")
    sums = {r[0]: r[1] for r in dealt.groupBy("task").agg(F.sum("group_size")).collect()}
    start, pairs = 0, []
    for k in sorted(sums):
        pairs.append((k, start))
        start += sums[k]
    offsets = F.broadcast(groups.sparkSession.createDataFrame(pairs, "task int, offset long"))
    in_task = Window.partitionBy("task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("group_size").over(in_task), F.lit(0))
    return dealt.withColumn("own", own).join(offsets, "task").select(*order, "group_size", "n", (F.col("own") + F.col("offset")).alias("start"))
