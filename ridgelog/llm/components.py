"""Connected components of links by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.session import checkpointed


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour, or to itself."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hub = _least(both).select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(hub, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    hub = _least(links)
    moved = links.join(hub, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(hub.select("u", F.col("least").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of the links ``(u, v)``; ``root`` is the smallest node of its component.

    Links are first turned so that ``u > v``. Every round is a few joins and
    map-side aggregates and is written to the shared folder; the number of rounds
    grows with the logarithm of the links, not with the length of a chain. The driver
    sees one count and one sum per round. Loops and repeated links do no harm.
    """
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = checkpointed(links, label)
    before = _mark(links)
    while before[0]:
        links = checkpointed(_small_star(_large_star(links)), label)
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
