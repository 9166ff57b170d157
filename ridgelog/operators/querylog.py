"""Analysis of a log of queries."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.functions.patterns import FIELD_COMPARISON


def index_suggestions(
    queries: DataFrame, column: str = "query", indexed: Sequence[str] = (), share: int = 10
) -> DataFrame:
    """Fields compared in more than one query out of ``share`` that have no index.

    Every comparison counts. The number of queries is a scalar subquery.
    """
    total = queries.agg(F.count(F.lit(1)).alias("total")).scalar()
    words = F.regexp_extract_all(F.col(column), F.lit(FIELD_COMPARISON), F.lit(1))
    usage = (
        queries.select(F.explode(words).alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    rated = usage.withColumn("total", total)
    return rated.filter(
        (F.col("uses") > F.floor(F.col("total") / share)) & ~F.col("field").isin(list(indexed))
    ).select(
        "field",
        F.lit("bloom_filter").alias("index_type"),
        "uses",
        F.format_string("Field used in %d queries", "uses").alias("reason"),
        (F.col("uses") / F.col("total")).alias("impact"),
    )
