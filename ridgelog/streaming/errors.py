"""Error statistics and anomalies that live on a stream.

Both work in two stateful steps. The first counts minutes, in any order of
arrival within the watermark's delay; a minute leaves it once the watermark has
passed. So the second step, a state machine per key, gets every minute once and
in the order of time, and its state stays small however hot a pattern is.
"""

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridgelog.functions.scalars import ntz
from ridgelog.operators.errors import DEVIATIONS, HISTORY, MIN_HISTORY, STATS_TTL, failing_logs, rated, with_hits
from ridgelog.operators.rollups import latest_per_key
from ridgelog.streaming.jobs import watermarked

VERSIONS = "category string, pattern string, first_us bigint, last_us bigint, count bigint, services map<string,bigint>, ended boolean"
SCORES = "service string, minute_us bigint, errors bigint, points int, mean double, std_dev double, z_score double, is_anomaly boolean"


def error_minutes(logs: DataFrame, delay: str) -> DataFrame:
    """Hits per minute, category, pattern and service, with the bounds of the minute's hits."""
    hits = with_hits(watermarked(logs, delay), "timestamp", "service")
    return (
        hits.groupBy(F.window("timestamp", "1 minute").alias("w"), "category", "pattern", "service")
        .agg(F.count(F.lit(1)).alias("hits"), F.unix_micros(F.min("timestamp")).alias("first_us"), F.unix_micros(F.max("timestamp")).alias("last_us"))
        .select(F.window_time("w").alias("at"), "category", "pattern", "service", "hits", "first_us", "last_us")
    )


class _Statistics(StatefulProcessor):
    """Statistics of one (category, pattern): three numbers, and a count for every service."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bounds = handle.getValueState("bounds", "first_us bigint, last_us bigint, count bigint")
        self.services = handle.getMapState("services", "service string", "count bigint")

    def _version(self, key, bounds: Sequence[int], services: dict[str, int], ended: bool) -> tuple:
        return (*key, *bounds, services, ended)

    def _timer(self, last_us: int) -> int:
        return (last_us + self.ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        minutes = pd.concat(list(rows)).sort_values("at", kind="stable")
        out, bounds, services = [], None, {}
        if self.bounds.exists():
            bounds = list(self.bounds.get())
            services = {k[0]: v[0] for k, v in self.services.iterator()}
            self.handle.deleteTimer(self._timer(bounds[1]))
        for _, minute in minutes.groupby("at", sort=False):
            first, last = int(minute["first_us"].min()), int(minute["last_us"].max())
            if bounds and first - bounds[1] > self.ttl_us:
                out.append(self._version(key, bounds, services, True))
                bounds, services = None, {}
                self.services.clear()
            bounds = [min(first, bounds[0]) if bounds else first, max(last, bounds[1]) if bounds else last, (bounds[2] if bounds else 0) + int(minute["hits"].sum())]
            for service, hits in minute.groupby("service")["hits"].sum().items():
                services[service] = services.get(service, 0) + int(hits)
        self.bounds.update(tuple(bounds))
        for service, n in services.items():
            self.services.updateValue((service,), (n,))
        self.handle.registerTimer(self._timer(bounds[1]))
        out.append(self._version(key, bounds, services, False))
        yield _versions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.bounds.exists():
            return
        bounds = tuple(self.bounds.get())
        if expiredTimerInfo.getExpiryTimeInMs() < self._timer(bounds[1]):
            return
        services = {k[0]: v[0] for k, v in self.services.iterator()}
        self.bounds.clear()
        self.services.clear()
        yield _versions([self._version(key, bounds, services, True)])

    def close(self) -> None:
        pass


def _versions(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["category", "pattern", "first_us", "last_us", "count", "services", "ended"])


def error_statistics_stream(logs: DataFrame, delay: str = "10 minutes", ttl: timedelta = STATS_TTL) -> DataFrame:
    """Versions of the statistics of every pattern of a stream of logs.

    Every micro-batch emits the new version of the patterns it touched: first and last time, count, and counts
    per service. A pattern that has been quiet for longer than ``ttl`` ends: a timer emits its last version as ended and
    removes the state, and the next hit starts anew. ``latest_statistics`` reduces the versions.
    """
    processor = _Statistics(int(ttl.total_seconds() * 1_000_000))
    return error_minutes(logs, delay).groupBy("category", "pattern").transformWithStateInPandas(processor, VERSIONS, "append", "EventTime")


def latest_statistics(versions: DataFrame, as_of: datetime, ttl: timedelta = STATS_TTL) -> DataFrame:
    """The last version of every stretch of activity of a pattern, with rate and trend.

    ``live`` tells the stretches that had not ended at ``as_of``; rates and trend of the others are those at the moment they ended.
    """
    latest = latest_per_key(versions, ["category", "pattern", "first_us"], ["last_us", "count", "ended"])
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    stats = latest.withColumns({"first_seen": at("first_us"), "last_seen": at("last_us")})
    ttl_sql = F.expr(f"INTERVAL '{int(ttl.total_seconds())}' SECOND")
    end = F.col("last_seen") + ttl_sql
    stats = stats.withColumn("live", ~F.col("ended") & (end >= ntz(as_of)))
    return rated(stats, F.when(F.col("live"), ntz(as_of)).otherwise(end)).select(
        "category", "pattern", "count", "services", "first_seen", "last_seen", "rate", "current_rate", "trend", "live"
    )


def service_minutes(logs: DataFrame, delay: str) -> DataFrame:
    """Logs with an error per service and minute."""
    failing = failing_logs(watermarked(logs, delay))
    return (
        failing.groupBy(F.window("timestamp", "1 minute").alias("w"), "service")
        .agg(F.count(F.lit(1)).alias("errors"))
        .select(F.window_time("w").alias("at"), F.unix_micros("w.start").alias("minute_us"), "service", "errors")
    )


class _Scores(StatefulProcessor):
    """The last points of one service, in a list that is used as a ring."""

    def __init__(self, history: int, least: int, deviations: float):
        self.history, self.least, self.deviations = history, least, deviations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "errors bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = [p[0] for p in self.points.get()] if self.points.exists() else []
        minutes = pd.concat(list(rows)).sort_values("minute_us", kind="stable")
        series = pd.Series([*points, *minutes["errors"].tolist()], dtype="int64")
        seen = series.rolling(self.history, min_periods=1)
        frame = pd.DataFrame({"points": seen.count().astype("int32"), "mean": _window_means(series, self.history), "std_dev": _window_spreads(series, self.history)}).iloc[len(points) :]
        frame.insert(0, "service", key[0])
        frame.insert(1, "minute_us", minutes["minute_us"].to_numpy())
        frame.insert(2, "errors", minutes["errors"].to_numpy())
        known = (frame["points"] >= self.least) & (frame["std_dev"] > 0)
        frame["z_score"] = ((frame["errors"] - frame["mean"]) / frame["std_dev"]).where(known)
        frame["is_anomaly"] = (frame["z_score"].abs() > self.deviations).fillna(False)
        self.points.put([(int(p),) for p in series.iloc[-(self.history - 1) :]])
        yield frame

    def close(self) -> None:
        pass


def _window_sums(series: pd.Series, history: int) -> tuple[list[int], list[int], list[int]]:
    """Number, sum and sum of squares of the last points, exact."""
    n, total, squares, out = 0, 0, 0, ([], [], [])
    values = series.tolist()
    for i, v in enumerate(values):
        n, total, squares = n + 1, total + v, squares + v * v
        if n > history:
            old = values[i - history]
            n, total, squares = n - 1, total - old, squares - old * old
        for column, x in zip(out, (n, total, squares)):
            column.append(x)
    return out


def _window_means(series: pd.Series, history: int) -> list[float]:
    n, total, _ = _window_sums(series, history)
    return [t / k for k, t in zip(n, total)]


def _window_spreads(series: pd.Series, history: int) -> list[float]:
    """Sample standard deviations, from exact sums."""
    return [((k * s - t * t) / (k * (k - 1))) ** 0.5 if k > 1 else float("nan") for k, t, s in zip(*_window_sums(series, history))]


def anomaly_stream(logs: DataFrame, delay: str = "10 minutes", history: int = HISTORY, min_history: int = MIN_HISTORY, deviations: float = DEVIATIONS) -> DataFrame:
    """Every minute of a service with errors, scored against the last ``history`` such minutes, the minute included.

    A minute is scored once the watermark has passed it. The state of a service is its last ``history`` points. ``scored`` gives the columns of the batch.
    """
    rows = service_minutes(logs, delay).groupBy("service")
    return rows.transformWithStateInPandas(_Scores(history, min_history, deviations), SCORES, "append", "EventTime")


def scored(scores: DataFrame) -> DataFrame:
    """The scores with the minute as a zone-free timestamp."""
    minute = F.timestamp_micros("minute_us").cast("timestamp_ntz").alias("minute")
    return scores.select("service", minute, "errors", "points", "mean", "std_dev", "z_score", "is_anomaly")
