"""Statistics of a stored table and the recommendations drawn from them."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelog.functions.scalars import readable_size

SMALL_PART = 100 * 1024 * 1024
LARGE_TABLE = 1024**4
LOW_RATIO = 2.0

# fixed values: the texts of the recommendations
USE_ZSTD = "Consider using ZSTD compression for better compression ratio"
SMALL_PARTS = "Too many small parts, consider adjusting merge settings"
ARCHIVE = "Large table size, consider implementing data archival strategy"


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from urllib.parse import unquote

    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for batch in batches:
        sizes = []
        for uri in batch["file"]:
            if uri.startswith("file:"):
                system, path = fs.LocalFileSystem(), "/" + unquote(uri[len("file:") :]).lstrip("/")
            else:
                system, path = fs.FileSystem.from_uri(uri)
            footer = pq.read_metadata(path, filesystem=system)
            groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
            columns = [g.column(j) for g in groups for j in range(g.num_columns)]
            sizes.append((footer.num_rows, sum(c.total_compressed_size for c in columns), sum(c.total_uncompressed_size for c in columns)))
        for k, name in enumerate(("rows", "compressed", "uncompressed")):
            batch[name] = [s[k] for s in sizes]
        yield batch


def file_info(spark: SparkSession, path: str, partition: str = "date_partition") -> DataFrame:
    """One row per file: partition, path, bytes, modification time, rows, compressed and uncompressed column bytes.

    The files are listed once and their footers read in tasks; no data page is
    touched. ``partition`` is any partition column of the table; it is null for
    rows without a timestamp.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    listed = files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    schema = "file string, bytes bigint, modified timestamp, rows bigint, compressed bigint, uncompressed bigint"
    value = F.url_decode(F.regexp_extract("file", rf"/{partition}=([^/]*)/", 1))
    value = F.when(value != "__HIVE_DEFAULT_PARTITION__", F.nullif(value, F.lit("")))
    value = value.cast("date") if partition == "date_partition" else value
    read = listed.mapInPandas(_footers, schema)
    return read.select(value.alias(partition), *read.columns)


def partition_info(files: DataFrame, partition: str = "date_partition") -> DataFrame:
    """Rows, bytes, files and last change per partition."""
    return files.groupBy(partition).agg(
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("parts"),
        F.max("modified").alias("last_modified"),
    )


def storage_statistics(files: DataFrame) -> DataFrame:
    """One row: rows, readable sizes, ratio, partitions, oldest and newest day.

    Input: ``file_info``, of any layout; the oldest and newest are partition values.
    The ratio is compressed over uncompressed.
    """
    partition = files.columns[0]
    total = files.agg(
        F.sum("rows").alias("total_rows"),
        F.sum("compressed").alias("c"),
        F.sum("uncompressed").alias("u"),
        F.count_distinct(partition).alias("partition_count"),
        F.min(partition).alias("oldest_date"),
        F.max(partition).alias("newest_date"),
    )
    return total.select(
        "total_rows",
        readable_size("c").alias("compressed_size"),
        readable_size("u").alias("uncompressed_size"),
        F.round(F.col("c") / F.col("u"), 4).alias("compression_ratio"),
        "partition_count",
        "oldest_date",
        "newest_date",
    )


def storage_analysis(files: DataFrame) -> DataFrame:
    """Totals of the table with recommendations. The ratio is uncompressed over compressed."""
    total = files.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("compressed"), F.lit(0)).alias("compressed_bytes"),
        F.coalesce(F.sum("uncompressed"), F.lit(0)).alias("uncompressed_bytes"),
        F.count(F.lit(1)).alias("total_parts"),
    )
    ratio = F.coalesce(F.try_divide("uncompressed_bytes", "compressed_bytes"), F.lit(0.0))
    return total.withColumn("compression_ratio", ratio).withColumn(
        "recommendations", recommendations("compression_ratio", "total_bytes", "total_parts")
    )


def recommendations(ratio: str, total_bytes: str, parts: str):
    mean_part = F.floor(F.try_divide(F.col(total_bytes), F.col(parts)))
    return F.array_compact(
        F.array(
            F.when(F.col(ratio) < LOW_RATIO, F.lit(USE_ZSTD)),
            F.when(mean_part < SMALL_PART, F.lit(SMALL_PARTS)),
            F.when(F.col(total_bytes) > LARGE_TABLE, F.lit(ARCHIVE)),
        )
    )
