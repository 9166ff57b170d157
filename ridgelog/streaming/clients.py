"""Live tails of many clients in one pass over the stream: an index of all their conditions.

Conditions of all clients are rows of a table, each different one once. A log meets them by equality joins only: on its values, on
the beginnings and ends of its texts in the lengths that conditions have, and on short character sequences that a searched text
starts with, which is then looked for. Each client is looked up by the one of its conditions that the fewest logs meet.
"""

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgelog.functions.scalars import attr
from ridgelog.session import checkpointed
from ridgelog.streaming.jobs import tail_view

_COLUMNS = ("level", "service", "message", "trace_id")
_KINDS = {"equals": "is", "=": "is", "not_equals": "is", "!=": "is", "contains": "has", "not_contains": "has", "starts_with": "begins", "ends_with": "ends"}
_NEGATED = ("not_equals", "!=", "not_contains")
#: characters of a searched text by which it is looked up
GRAM = 4


@dataclass(frozen=True)
class ClientIndex:
    """The conditions of all clients. ``tests`` are (test, field, kind, value), ``needs`` (client, test, wanted); ``open`` are clients without a wanted condition."""

    tests: list[tuple[int, str, str, str]]
    needs: list[tuple[str, int, bool]]
    open: list[str]


def client_index(clients: Mapping[str, Iterable[Mapping[str, str]]]) -> ClientIndex:
    """The index of ``client -> filters``; a client with an unknown operator is never served, one without filters gets everything."""
    numbers: dict[tuple[str, str, str], int] = {}
    needs: set[tuple[str, int, bool]] = set()
    open_ = []
    for client, filters in clients.items():
        own, never = set(), False
        for f in filters:
            kind, value = _KINDS.get(f["operator"]), f["value"].lower()
            wanted = f["operator"] not in _NEGATED
            if kind is None or (kind != "is" and not value and not wanted):
                never = True
            elif kind == "is" or value:  # the empty text is in all texts
                own.add((client, numbers.setdefault((f["field"], kind, value), len(numbers)), wanted))
        if never:
            continue
        needs |= own
        if not any(wanted for *_, wanted in own):
            open_.append(client)
    return ClientIndex([(n, *t) for t, n in numbers.items()], sorted(needs), open_)


def _met(rows: DataFrame, index: ClientIndex) -> DataFrame:
    """``(_row, test)``: the tests that each row meets."""
    spark = rows.sparkSession
    value = lambda name: F.lower(F.col(name) if name in _COLUMNS else attr(name))
    found = []
    for kind in sorted({t[2] for t in index.tests}):
        tests = [(n, f, v) for n, f, k, v in index.tests if k == kind]
        fields = sorted({f for _, f, _ in tests})
        texts = rows.select("_row", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("text")) for f in fields])).alias("v")).select("_row", "v.*")
        size = F.length("text")
        lengths = lambda cut: F.array(*[F.lit(n) for n in sorted({cut(v) for *_, v in tests})])
        if kind == "is":
            keyed, key = texts.withColumn("key", F.col("text")), lambda v: v
        elif kind in ("begins", "ends"):
            part = (lambda n: F.substring("text", F.lit(1), n)) if kind == "begins" else (lambda n: F.substring("text", -n, n))
            fitting = F.filter(lengths(len), lambda n: n <= size)
            keyed, key = texts.withColumn("key", F.explode(F.transform(fitting, part))), lambda v: v
        else:
            grams = F.flatten(F.transform(F.filter(lengths(lambda v: min(len(v), GRAM)), lambda n: n <= size), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("text", i, n))))
            keyed, key = texts.withColumn("key", F.explode(F.array_distinct(grams))), lambda v: v[:GRAM]
        table = spark.createDataFrame([(n, f, v, key(v)) for n, f, v in tests], "test int, field string, value string, key string")
        met = keyed.join(F.broadcast(table), ["field", "key"])
        found.append((met.filter(F.col("text").contains(F.col("value"))) if kind == "has" else met).select("_row", "test"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _by_client(index: ClientIndex, wanted: bool) -> dict[str, set[int]]:
    """The tests that each client wants to be met, or not to be met; a client without any is missing."""
    tests: dict[str, set[int]] = {}
    for client, test, want in index.needs:
        if want == wanted:
            tests.setdefault(client, set()).add(test)
    return tests


def deliveries(logs: DataFrame, index: ClientIndex) -> DataFrame:
    """``(client, ...)``: the tail columns of every log for every client whose conditions it meets, ignoring case.

    Pairs of a log and a client come only from the client's rarest wanted condition; its others are then looked up among those the
    log meets. The tables of conditions and clients are made on the driver, so they are broadcast; logs are shuffled by their number only.
    Clients that want nothing in particular get every log but those that meet a condition they exclude.
    """
    spark = logs.sparkSession
    # stored, so that the number of a row is the same in every join
    rows = checkpointed(logs.withColumn("_row", F.monotonically_increasing_id()), "tail-rows")
    pairs = None
    if index.tests:
        met = checkpointed(_met(rows, index), "tail-met")
        often = {r["test"]: r["n"] for r in met.groupBy("test").agg(F.count(F.lit(1)).alias("n")).collect()}
        wants, bans = _by_client(index, True), _by_client(index, False)
        access = [(min(tests, key=lambda t: (often.get(t, 0), t)), client, sorted(tests), sorted(bans.get(client, ()))) for client, tests in wants.items()]
        table = spark.createDataFrame(access, "test int, client string, wants array<int>, bans array<int>")
        # all tests that a row meets stand beside it, so a client's conditions are decided in place
        own = met.groupBy("_row").agg(F.collect_set("test").alias("tests")).select("_row", "tests", F.explode("tests").alias("test"))
        near = own.join(F.broadcast(table), "test")
        kept = near.filter((F.size(F.array_except("wants", "tests")) == 0) & ~F.arrays_overlap("bans", "tests"))
        pairs = kept.select("_row", "client")
    if index.open:
        free = rows.select("_row", F.explode(F.array(*[F.lit(c) for c in index.open])).alias("client"))
        if index.tests:
            unwanted = [(t, c) for c in index.open for t in sorted(bans.get(c, ()))]
            excluded = met.join(F.broadcast(spark.createDataFrame(unwanted, "test int, client string")), "test").select("_row", "client").distinct()
            free = free.join(excluded, ["_row", "client"], "left_anti")
        pairs = free if pairs is None else pairs.unionByName(free)
    if pairs is None:
        pairs = spark.createDataFrame([], "_row bigint, client string")
    return tail_view(pairs.join(rows.withColumn("log_id", F.col("id")), "_row"), "client", "log_id")


def clients_sink(logs: DataFrame, clients: Mapping[str, Iterable[Mapping[str, str]]], path: str, checkpoint: str, *, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Serve all clients from one stream: every micro-batch is read once, and its deliveries are written to a folder of its own.

    A repeated micro-batch overwrites its folder, so nothing is delivered twice. Folders are partitioned by client,
    and the deliveries of a client are gathered first, so they are few files however many tasks found them.
    """
    index = client_index(clients)

    def serve(batch: DataFrame, batch_id: int) -> None:
        deliveries(batch, index).hint("rebalance", "client").write.mode("overwrite").partitionBy("client").parquet(f"{path}/batch={batch_id}")

    return logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(serve).trigger(**(trigger or {"processingTime": "1 second"})).start()


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """All deliveries so far."""
    schema = "client string, id string, timestamp timestamp_ntz, level string, service string, message string, trace_id string, log_id string, batch bigint"
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
