"""Ingest projections: JSON logs, mixed lines, defaults, agent fields, batch summaries."""

import operator
from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgelog.functions.scalars import merge_maps, ntz
from ridgelog.functions.timeparse import parse_rfc3339
from ridgelog.schema import LOG_FIELDS

#: shape of one JSON log on the wire; attribute values of any JSON type arrive as text
WIRE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)
TCP_SERVICE = "tcp-client"


def with_defaults(df: DataFrame, *, as_of: datetime, service: str = "unknown") -> DataFrame:
    """Fill id, timestamp, level, service and the empty text fields of incoming logs.

    Generated ids are random but seeded per plan and partition, so a recomputed
    task (lost executor, speculative copy) gives its rows the same ids again,
    while equal logs keep different ids.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("message", "trace_id", "span_id")}
    df = df.withColumns(
        {
            **text,
            "timestamp": F.coalesce(F.col("timestamp"), ntz(as_of)),
            "level": F.coalesce(F.nullif("level", F.lit("")), F.lit("info")),
            "service": F.coalesce(F.nullif("service", F.lit("")), F.lit(service)),
            "attributes": F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>")),
        }
    )
    return df.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.uuid())).select(*LOG_FIELDS)


def _from_wire(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", parse_rfc3339("timestamp"))


def read_json_logs(spark: SparkSession, path: str, *, as_of: datetime, streaming: bool = False) -> DataFrame:
    """Scan JSON files of logs: one object or one array of objects per line; malformed lines yield no rows."""
    reader = spark.readStream if streaming else spark.read
    return decode_bodies(reader.text(path), as_of=as_of)


def read_json_rejects(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """The lines of JSON files that hold no log, with the reason."""
    reader = spark.readStream if streaming else spark.read
    return rejected_bodies(reader.text(path))


def _reason(column: str) -> Column:
    """Why a body is rejected, null if it is accepted. An empty body has nothing to reject."""
    # in brackets, because the parser does not mind text behind a whole document
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]"))), "$", "array<variant>")
    doc = F.when(F.size(whole) == 1, whole[0])
    kind = F.schema_of_variant(doc)
    body = F.coalesce(F.col(column), F.lit(""))
    elements = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array())
    others = F.exists(elements, lambda e: ~F.schema_of_variant(e).startswith("OBJECT"))
    return (
        F.when(F.trim(body) == "", F.lit(None))
        .when(doc.isNull(), F.lit("malformed JSON"))
        .when(kind.startswith("OBJECT"), F.lit(None))
        .when(~kind.startswith("ARRAY"), F.lit("no log or array of logs"))
        .when(others, F.lit("array with elements that are no logs"))
    )


def decode_bodies(df: DataFrame, column: str = "value", *, as_of: datetime) -> DataFrame:
    """Request bodies to logs; a body is an array of logs or a single log.

    A body that is malformed, or holds anything but logs, yields no rows at all, as one
    request fails as a whole; ``rejected_bodies`` has it. A member of the wrong type reads as missing.
    """
    accepted = df.filter(_reason(column).isNull())
    one = F.from_json(column, WIRE_SCHEMA)
    many = F.from_json(column, T.ArrayType(WIRE_SCHEMA))
    body = F.ltrim(F.col(column))
    items = F.when(body.startswith("["), many).when(body.startswith("{"), F.array(one))
    logs = accepted.select(F.explode(items).alias("log")).filter(F.col("log").isNotNull()).select("log.*")
    return with_defaults(_from_wire(logs), as_of=as_of)


def rejected_bodies(df: DataFrame, column: str = "value") -> DataFrame:
    """The bodies that ``decode_bodies`` leaves out, with the other columns, and the ``reason``."""
    return df.withColumn("reason", _reason(column)).filter(F.col("reason").isNotNull())


def _is_wire_log(doc) -> Column:
    """A JSON object whose members have the types of a log and whose time is RFC 3339."""

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant")), F.lit("VOID"))

    texts = [kind(f).isin("STRING", "VOID") for f in LOG_FIELDS if f not in ("timestamp", "attributes")]
    attributes = kind("attributes")
    stamp = F.try_variant_get(doc, "$.timestamp", "string")
    times = (kind("timestamp") == "VOID") | ((kind("timestamp") == "STRING") & parse_rfc3339(stamp).isNotNull())
    return reduce(operator.and_, texts) & (attributes.startswith("OBJECT") | (attributes == "VOID")) & times


def decode_lines(df: DataFrame, column: str = "value", *, as_of: datetime) -> DataFrame:
    """NDJSON or plain text lines: a JSON log, else a text log of service tcp-client."""
    text = F.col(column)
    doc = F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))
    staged = df.filter(text != "").select(text.alias("_line"), doc.alias("_doc"))
    is_log = F.coalesce(F.col("_doc").isNotNull() & _is_wire_log(F.col("_doc")), F.lit(False))
    log = F.when(is_log, F.from_json("_line", WIRE_SCHEMA))
    staged = staged.withColumn("_log", log)
    logs = staged.select(
        *[
            F.when(F.col("_log").isNotNull(), F.col("_log")[f]).otherwise(
                F.col("_line") if f == "message" else F.lit(None)
            ).alias(f)
            for f in LOG_FIELDS
        ]
    )
    return with_defaults(_from_wire(logs), as_of=as_of, service=TCP_SERVICE)


def read_lines(spark: SparkSession, path: str, *, as_of: datetime, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return decode_lines(reader.text(path), as_of=as_of)


def with_batch(df: DataFrame, batch: str) -> DataFrame:
    return df.withColumn("batch", F.lit(batch))


def bulk_summary(df: DataFrame, batch_column: str = "batch") -> DataFrame:
    """One summary record per bulk request: number of logs and their time span."""
    return df.groupBy(batch_column).agg(
        F.count(F.lit(1)).alias("log_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def with_agent_fields(
    df: DataFrame, defaults: Mapping[str, str], error_column: str | None = None
) -> DataFrame:
    """Add default attributes under the ones of the record, and the error text as ``error``."""
    pairs = [F.lit(x) for pair in defaults.items() for x in pair]
    base = F.create_map(*pairs).cast("map<string,string>")
    df = df.withColumn("attributes", merge_maps(base, F.col("attributes")))
    if error_column is None:
        return df
    error = F.when(
        F.col(error_column) != "",
        merge_maps(F.col("attributes"), F.create_map(F.lit("error"), F.col(error_column))),
    )
    return df.withColumn("attributes", F.coalesce(error, F.col("attributes")))
