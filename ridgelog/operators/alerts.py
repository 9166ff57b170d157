"""Alert rules as data, their evaluation on metric series, and alert episodes."""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridgelog.operators.alertblocks import episodes_by_blocks
from ridgelog.operators.rollups import latest_per_key
from ridgelog.session import checkpointed

_TESTS = {
    ">": lambda v, t: v > t,
    "<": lambda v, t: v < t,
    "=": lambda v, t: v == t,
}


@dataclass(frozen=True)
class AlertRule:
    name: str
    severity: str
    metric: str
    comparator: str
    threshold: float
    cooldown_seconds: int
    #: what a triggered check says, as a format of its value
    message: str = ""


# fixed values: the default rules
DEFAULT_RULES = (
    AlertRule("high_ingestion_rate", "warning", "ingestion_rate_per_second", ">", 10000.0, 300, "Ingestion rate is %.0f logs/sec (threshold: 10000)"),
    AlertRule("slow_queries", "warning", "query_duration_ms_p99", ">", 5000.0, 300, "99th percentile query duration is %.0fms (threshold: 5000ms)"),
    AlertRule("high_memory_usage", "critical", "memory_alloc_mb", ">", 1024.0, 300, "Memory usage is %.0fMB (threshold: 1024MB)"),
    AlertRule("low_storage_space", "critical", "storage_free_percent", "<", 10.0, 1800, "Only %.1f%% storage space remaining"),
    AlertRule("no_recent_logs", "info", "ingestion_rate_per_second", "=", 0.0, 600, "No logs received in the last minute"),
)


def evaluate_rules(metrics: DataFrame, rules: Sequence[AlertRule] = DEFAULT_RULES) -> DataFrame:
    """Rule outcomes for (name, value, at) samples.

    The rules are literals of the plan: every sample is matched against them by
    an exploded constant array, without a join.
    """
    outcomes = []
    for rule in rules:
        hit = _TESTS[rule.comparator](F.col("value"), F.lit(rule.threshold))
        outcomes.append(
            F.when(
                F.col("name") == rule.metric,
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.lit(rule.severity).alias("severity"),
                    F.lit(rule.cooldown_seconds).alias("cooldown"),
                    F.coalesce(hit, F.lit(False)).alias("triggered"),
                ),
            )
        )
    checked = metrics.withColumn("outcome", F.explode(F.array_compact(F.array(*outcomes))))
    return checked.select(
        "outcome.rule", "outcome.severity", "outcome.cooldown", "at", "value", "outcome.triggered"
    )


def alert_messages(checks: DataFrame, rules: Sequence[AlertRule] = DEFAULT_RULES) -> DataFrame:
    """The triggered checks with the text of their rule; a rule without a text states metric, value and threshold.

    The message of an alert is that of its last triggered check.
    """
    text = F.lit(None).cast("string")
    for rule in rules:
        stated = F.format_string(rule.message or f"{rule.metric} is %.2f (threshold: {rule.threshold:g})", F.col("value").cast("double"))
        text = F.when(F.col("rule") == rule.name, stated).otherwise(text)
    return checks.filter("triggered").withColumn("message", text)


def episodes(checks: DataFrame, keys: Sequence[str] = ("rule",)) -> DataFrame:
    """Alert episodes without cooldown: runs of triggered checks.

    Gaps and islands; ``end_at`` is the first check after the run, null while
    the alert is active. Input is one check per rule and step.
    """
    by_time = Window.partitionBy(*keys).orderBy("at")
    run = F.sum(F.when(F.col("triggered"), 0).otherwise(1)).over(
        by_time.rowsBetween(Window.unboundedPreceding, 0)
    )
    marked = checks.withColumn("_run", run).withColumn("_next", F.lead("at").over(by_time))
    on = marked.filter("triggered").groupBy(*keys, "severity", "_run")
    return on.agg(
        F.min("at").alias("start_at"),
        F.max("at").alias("last_at"),
        F.max(F.struct("at", "_next"))["_next"].alias("end_at"),
        F.count(F.lit(1)).alias("count"),
    ).drop("_run")


@dataclass
class _Machine:
    """Sequential state of one rule: a trigger silences the rule for its cooldown."""

    rule: str
    start_at: int = -1
    last_at: int = -1
    count: int = 0
    quiet_until: int = -1

    def row(self, severity: str, end_at: int | None) -> tuple:
        return (self.rule, severity, self.start_at, self.last_at, end_at, self.count)

    def feed(self, checks: pd.DataFrame) -> list[tuple]:
        """Process checks by time; returns the alerts that were closed."""
        closed = []
        for check in checks.sort_values("at").itertuples(index=False):
            if check.at < self.quiet_until:
                continue
            if check.triggered:
                if self.start_at < 0:
                    self.start_at, self.count = check.at, 0
                self.last_at, self.count = check.at, self.count + 1
                self.quiet_until = check.at + check.cooldown
            elif self.start_at >= 0:
                self.last_at = check.at
                closed.append(self.row(check.severity, check.at))
                self.start_at = -1
        return closed


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ["rule", "severity", "start_at", "last_at", "end_at", "count"]
    frame = pd.DataFrame(rows, columns=columns)
    frame["end_at"] = frame["end_at"].astype("Int64")
    return frame


def _walk(checks: pd.DataFrame) -> pd.DataFrame:
    machine = _Machine(checks["rule"].iloc[0])
    rows = machine.feed(checks)
    if machine.start_at >= 0:
        rows.append(machine.row(checks["severity"].iloc[0], None))
    return _frame(rows)


EPISODE_SCHEMA = "rule string, severity string, start_at bigint, last_at bigint, end_at bigint, count bigint"


def relevant_checks(checks: DataFrame) -> DataFrame:
    """Checks that can change an alert: triggered ones, and quiet ones up to a cooldown after.

    A quiet check matters only when it is the first that is evaluated after a
    trigger, which lies within one cooldown plus one step of the trigger. Long
    quiet stretches shrink to their beginning, so the walk sees little more than
    the alerts themselves.
    """
    by_time = Window.partitionBy("rule").orderBy("at")
    last_on = F.last(F.when(F.col("triggered"), F.col("at")), ignorenulls=True).over(
        by_time.rowsBetween(Window.unboundedPreceding, 0)
    )
    previous = F.lag("at").over(by_time)
    marked = checks.withColumn("_on", last_on).withColumn("_previous", previous)
    first_after = F.col("_previous").isNull() | (F.col("_previous") - F.col("_on") <= F.col("cooldown"))
    keep = F.col("triggered") | (F.col("_on").isNotNull() & first_after)
    return marked.filter(keep).drop("_on", "_previous")


#: up to so many checks of each rule are walked rule by rule; beyond that by blocks of time
WALK_MOST = 1 << 16


def episodes_with_cooldown(checks: DataFrame, walk_most: int = WALK_MOST) -> DataFrame:
    """Alert episodes where a trigger suspends the rule for its cooldown.

    While cooling a rule is not evaluated, so it can neither count nor resolve.
    Checks of a rule at the same time count as one, triggered if any of them is. The walk is
    sequential: while no rule has more than ``walk_most`` checks every rule is walked in one group,
    of that proven size; else all are walked in blocks of time, with the same result.
    """
    narrow = checkpointed(one_check_a_time(checks), "alert-checks")
    most = narrow.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > walk_most:
        return episodes_by_blocks(narrow)
    return relevant_checks(narrow).groupBy("rule").applyInPandas(_walk, EPISODE_SCHEMA)


def one_check_a_time(checks: DataFrame) -> DataFrame:
    """Checks reduced to one per rule and time."""
    return checks.groupBy("rule", "at").agg(F.min("severity").alias("severity"), F.max("cooldown").alias("cooldown"), F.max("triggered").alias("triggered"))


class _Alerts(StatefulProcessor):
    """The walk of one rule: four numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", "start_at bigint, last_at bigint, count bigint, quiet_until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = _Machine(key[0], *(self.numbers.get() if self.numbers.exists() else ()))
        due = pd.concat(list(rows))
        out = machine.feed(due)
        if machine.start_at >= 0:
            out.append(machine.row(due["severity"].iloc[-1], None))
        self.numbers.update((int(machine.start_at), int(machine.last_at), int(machine.count), int(machine.quiet_until)))
        yield _frame(out)

    def close(self) -> None:
        pass


def episode_stream(checks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alert episodes of a stream of checks that arrive in any order within ``delay``.

    Checks wait for the watermark in a first aggregate, by rule and second, so those of one rule are
    spread over tasks. Those that it has passed go to the walk of their rule in the order of time, so the
    alerts are those of the batch; its state is four numbers. Every micro-batch emits the alerts it closed
    and the current version of the open one; ``latest_episodes`` reduces the versions.
    """
    timed = checks.withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", delay)
    settled = timed.groupBy(F.window("_time", "1 second").alias("_w"), "rule").agg(
        F.min("at").alias("at"), F.min("severity").alias("severity"), F.max("cooldown").alias("cooldown"), F.max("triggered").alias("triggered")
    )
    narrow = settled.select(F.window_time("_w").alias("_time"), "rule", "at", "severity", "cooldown", "triggered")
    return narrow.groupBy("rule").transformWithStateInPandas(_Alerts(), EPISODE_SCHEMA, "append", "EventTime")


def latest_episodes(versions: DataFrame) -> DataFrame:
    """The last version of every alert; a closed one is later than its open versions."""
    return latest_per_key(versions, ["rule", "start_at"], ["last_at", "count"])


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("end_at").isNull())


def status(alerts: DataFrame) -> Column:
    return F.when(alerts["end_at"].isNull(), F.lit("active")).otherwise(F.lit("resolved"))
