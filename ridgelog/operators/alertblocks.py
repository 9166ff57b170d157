"""The walk of alert rules over their checks, cut into blocks of time.

Whether a check is evaluated depends on the cooldown of earlier ones, so the walk is sequential. But a block
of time can be entered in a few ways only: at one of the checks within one cooldown of its beginning, or behind
these. Each block works out, for every entry, where the walk goes on in the next block. Following these
steps by pointer doubling tells the entry of each block, and then all blocks walk at once. Alerts that
reach over the edge of a block are joined by the same doubling. No task sees more of a rule than a block.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.operators.spantree import climbed
from ridgelog.session import checkpointed

#: seconds of a block; never less than the longest cooldown
BLOCK_SECONDS = 1 << 16
_OWN, _NEXT, _BLOCK = 0, 1, 2
_PIECES = "rule string, node string, up string, severity string, start_at bigint, last_at bigint, end_at bigint, count bigint"


def _arrays(checks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, outcomes, and for each check the place of the next one that is evaluated after it."""
    at = checks["at"].to_numpy(np.int64)
    on = checks["triggered"].to_numpy(bool)
    behind = np.arange(1, len(at) + 1)
    after = np.maximum(np.searchsorted(at, at + checks["cooldown"].to_numpy(np.int64)), behind)
    return at, on, np.where(on, after, behind)


def _steps(longest: int, width: int):
    """The transition of one block: from every entry to the entry of the next block."""

    def step(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rule, block = key
        if not (frame["kind"] == _BLOCK).any():  # before the first block
            return pd.DataFrame(columns=["trace_id", "span_id", "up", "steps", "done", "size"])
        checks = frame[frame["kind"] == _OWN].sort_values("at")
        follow = np.sort(frame.loc[frame["kind"] == _NEXT, "at"].to_numpy(np.int64))
        about = frame[frame["kind"] == _BLOCK].iloc[0]
        at, on, after = _arrays(checks)
        quiet = np.where(on, at + checks["cooldown"].to_numpy(np.int64), 0)
        leave = np.zeros(len(at) + 1, np.int64)
        for i in range(len(at) - 1, -1, -1):
            leave[i] = leave[after[i]] if after[i] < len(at) else quiet[i]
        head = block * width + longest
        first_behind = int(np.searchsorted(at, head))
        places = [*range(first_behind), first_behind]
        names = [f"{block}:{at[i]}" for i in range(first_behind)] + [f"{block}:"]
        last = block == about["until"]
        rows = []
        for i, name in zip(places, names):
            k = int(np.searchsorted(follow, leave[i] if i < len(at) else 0))
            up = name if last else f"{block + 1}:{follow[k] if k < len(follow) else ''}"
            rows.append((rule, name, up, 0 if last else 1, bool(last), 0))
        if block == about["at"]:  # the walk begins at the first check
            begin = 0 if first_behind else len(rows) - 1
            rows[begin] = (*rows[begin][:5], 1)
        return pd.DataFrame(rows, columns=["trace_id", "span_id", "up", "steps", "done", "size"])

    return step


def _walks(longest: int, width: int):
    """The alerts of one block from its entry, and the door by which an alert of the block before comes in."""

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rule, block = key
        checks = frame[frame["kind"] == _OWN].sort_values("at")
        entry = frame[frame["kind"] == _BLOCK].iloc[0]
        at, on, after = _arrays(checks)
        i = int(np.searchsorted(at, block * width + longest if entry["at"] < 0 else entry["at"]))
        door, beyond = f"door:{block}", f"door:{block + 1}"
        rows, run, seen = [], None, False
        while i < len(at):
            if on[i]:
                if run is None:
                    run = [int(at[i]), int(at[i]), 0]
                    if not seen:
                        rows.append((rule, door, f"alert:{run[0]}", None, None, None, None, 0))
                run[1], run[2] = int(at[i]), run[2] + 1
            else:
                if not seen:
                    rows.append((rule, door, None, None, None, None, int(at[i]), 0))
                if run is not None:
                    rows.append((rule, f"alert:{run[0]}", None, checks["severity"].iloc[i], run[0], int(at[i]), int(at[i]), run[2]))
                    run = None
            seen, i = True, int(after[i])
        if not seen:
            rows.append((rule, door, beyond, None, None, None, None, 0))
        if run is not None:
            rows.append((rule, f"alert:{run[0]}", beyond, checks["severity"].iloc[0], run[0], run[1], None, run[2]))
        out = pd.DataFrame(rows, columns=["rule", "node", "up", "severity", "start_at", "last_at", "end_at", "count"])
        if block == entry["until"]:
            out["up"] = out["up"].where(out["up"] != beyond, None)
        return out.astype({c: "Int64" for c in ("start_at", "last_at", "end_at")})

    return walk


def episodes_by_blocks(checks: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Alert episodes with cooldown of ``checks`` with one row per rule and time; the same as a walk of each rule.

    ``(rule, severity, start_at, last_at, end_at, count)``. Times are not null and not below 0.
    """
    narrow = checks.select("rule", "severity", F.col("cooldown").cast("bigint").alias("cooldown"), "at", "triggered")
    longest = narrow.agg(F.max("cooldown")).first()[0] or 0
    width = max(block_seconds, longest, 1)
    own = narrow.withColumns({"block": F.floor(F.col("at") / width), "kind": F.lit(_OWN), "until": F.lit(None).cast("bigint")})
    # every block between the first and the last check of a rule has a row, also without checks
    bounds = own.groupBy("rule").agg(F.min("block").alias("from"), F.max("block").alias("until"))
    marks = bounds.select("rule", F.explode(F.sequence("from", "until")).alias("block"), F.col("from").alias("at"), "until")
    blank = {"severity": F.lit(None).cast("string"), "cooldown": F.lit(0).cast("bigint"), "triggered": F.lit(False), "kind": F.lit(_BLOCK)}
    early = own.filter(F.col("at") - F.col("block") * width < longest).withColumns({"block": F.col("block") - 1, "kind": F.lit(_NEXT)})
    grouped = own.unionByName(early).unionByName(marks.withColumns(blank)).groupBy("rule", "block")
    steps = grouped.applyInPandas(_steps(longest, width), "trace_id string, span_id string, up string, steps bigint, done boolean, size bigint")
    reached = climbed(steps, "alert-steps").filter(F.col("size") > 0)
    place = F.split("span_id", ":")
    entry = reached.select(F.col("trace_id").alias("rule"), place[0].cast("bigint").alias("block"), F.coalesce(F.nullif(place[1], F.lit("")).cast("bigint"), F.lit(-1)).alias("at"))
    entry = entry.join(bounds.select("rule", "until"), "rule").withColumns(blank)
    pieces = own.unionByName(entry).groupBy("rule", "block").applyInPandas(_walks(longest, width), _PIECES)
    pieces = checkpointed(pieces, "alert-pieces")
    root = F.col("up").isNull()
    links = pieces.select(F.col("rule").alias("trace_id"), F.col("node").alias("span_id"), F.coalesce("up", "node").alias("up"), (~root).cast("bigint").alias("steps"), root.alias("done"), F.lit(0).cast("bigint").alias("size"))
    whole = climbed(links, "alert-links").select(F.col("trace_id").alias("rule"), F.col("span_id").alias("node"), F.col("up").alias("root"))
    ends = pieces.select("rule", F.col("node").alias("root"), F.col("end_at").alias("closed"))
    joined = pieces.filter("start_at IS NOT NULL").join(whole, ["rule", "node"]).join(ends, ["rule", "root"])
    return joined.groupBy("rule", "root").agg(
        F.min_by("severity", "start_at").alias("severity"),
        F.min("start_at").alias("start_at"),
        F.coalesce(F.max("closed"), F.max("last_at")).alias("last_at"),
        F.max("closed").alias("end_at"),
        F.sum("count").alias("count"),
    ).drop("root")
