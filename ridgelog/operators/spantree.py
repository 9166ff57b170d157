"""Depth, root and size of the span tree by pointer doubling.

A round doubles the distance that every span looks up its trace, so a chain of n
spans takes log2(n) rounds, each a few equi-joins by (trace, span). No task sees
a whole trace, and a parent with very many children is a skewed join side,
which AQE splits; sizes are summed on the map side before they are shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.session import checkpointed

_KEY = ["trace_id", "span_id"]


def _pointers(spans: DataFrame) -> DataFrame:
    """``(trace_id, span_id, up, steps, done, size)``: every span points to its parent; one without a known parent is a root and points to itself."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("known"))
    linked = spans.select(*_KEY, "parent_id").join(known, ["trace_id", "parent_id"], "left")
    child = F.col("known").isNotNull()
    return linked.select(
        *_KEY,
        F.when(child, F.col("parent_id")).otherwise(F.col("span_id")).alias("up"),
        child.cast("bigint").alias("steps"),
        (~child).alias("done"),
        F.lit(1).cast("bigint").alias("size"),
    )


def _doubled(rows: DataFrame) -> DataFrame:
    """One round: a span that points 2^k up now points 2^(k+1) up, or to its root.

    ``size`` counts the spans of the subtree less than 2^k below. Those between 2^k and 2^(k+1) below are counted by the spans
    exactly 2^k below, which are the ones that point here.
    """
    open_ = rows.filter(~F.col("done"))
    target = rows.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
    moved = open_.join(target, ["trace_id", "up"]).select(*_KEY, F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"), "size")
    more = open_.groupBy("trace_id", F.col("up").alias("span_id")).agg(F.sum("size").alias("_more"))
    both = rows.filter("done").unionByName(moved).join(more, _KEY, "left")
    return both.select(*_KEY, "up", "steps", "done", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))


def climbed(rows: DataFrame, label: str) -> DataFrame:
    """Rounds of doubling until every row of ``(trace_id, span_id, up, steps, done, size)`` points to its root.

    Rows start with ``steps`` 1 and pointing to their parent, or as done roots with 0 and pointing to themselves. ``size`` becomes the sum of the sizes
    in the subtree. Each round is written to the shared folder; the driver sees one row per round. Rounds also end when the
    distance exceeds the number of rows of every trace that has open ones; these then lead into a circle.
    """
    rows, sizes, step = checkpointed(rows, label), None, 1
    while True:
        left = rows.filter(~F.col("done")).select("trace_id").distinct()
        if left.isEmpty():
            return rows
        if sizes is None:
            sizes = checkpointed(rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans")), f"{label}-counts")
        if step >= sizes.join(left, "trace_id", "left_semi").agg(F.max("spans")).first()[0]:
            return rows
        rows = checkpointed(_doubled(rows), label)
        step *= 2


def span_depths(spans: DataFrame) -> DataFrame:
    """``(trace_id, span_id, depth, root_span_id, subtree_size, in_cycle)`` for every span.

    ``spans`` has one row per (trace_id, span_id) with its ``parent_id``. A span whose parent is '' or null, or not among the
    spans of its trace, is a root of depth 0. ``subtree_size`` counts the span itself. Spans may name each
    other as parents: those on such a circle are marked ``in_cycle`` and have no size, and they and all below them have no depth
    and no root. An empty table gives no rows.
    """
    rows = climbed(_pointers(spans.select(*_KEY, F.coalesce("parent_id", F.lit("")).alias("parent_id"))), "span-pointers")
    circle = rows.filter(~F.col("done")).select("trace_id", F.col("up").alias("span_id")).distinct().withColumn("_circle", F.lit(True))
    marked = rows.join(circle, _KEY, "left").withColumn("in_cycle", F.col("_circle").isNotNull())
    return marked.select(
        *_KEY,
        F.when(F.col("done"), F.col("steps")).alias("depth"),
        F.when(F.col("done"), F.col("up")).alias("root_span_id"),
        F.when(~F.col("in_cycle"), F.col("size")).alias("subtree_size"),
        "in_cycle",
    )
