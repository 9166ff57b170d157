"""Syslog decoding: RFC 5424, then RFC 3164, else an unknown line."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelog.functions.patterns import SYSLOG_3164, SYSLOG_5424, SYSLOG_FACILITY, SYSLOG_SEVERITY
from ridgelog.functions.scalars import ntz, present_attributes
from ridgelog.functions.timeparse import parse_rfc3339, parse_yearless


def _named(names: tuple[str, ...], number: Column) -> Column:
    """Name by number, '' outside of the table."""
    table = F.array(*[F.lit(n) for n in names])
    return F.coalesce(F.try_element_at(table, number + 1), F.lit(""))


def _entries(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def decode_syslog(
    df: DataFrame, column: str = "value", *, as_of: datetime, source_column: str | None = None
) -> DataFrame:
    """Log fields of syslog lines; severity is PRI & 7 and facility PRI >> 3.

    RFC 3164 carries no year and takes the one of ``as_of``. A missing or broken
    timestamp becomes ``as_of``. A PRI beyond the named facilities has none, and one
    that is no 64-bit number counts as 0.
    """
    line = F.col(column)
    others = [c for c in df.columns if c not in (column, source_column)]
    kind = F.when(line.rlike(SYSLOG_5424), F.lit("RFC5424")).when(line.rlike(SYSLOG_3164), F.lit("RFC3164"))
    staged = df.withColumn("_kind", F.coalesce(kind, F.lit("unknown")))
    k = F.col("_kind")

    def g5(i: int) -> Column:
        return F.regexp_extract(line, SYSLOG_5424, i)

    def g3(i: int) -> Column:
        return F.regexp_extract(line, SYSLOG_3164, i)

    pri = F.when(k == "RFC5424", g5(1)).when(k == "RFC3164", g3(1)).try_cast("bigint")
    staged = staged.withColumn("_pri", F.coalesce(pri, F.lit(0)))
    severity = _named(SYSLOG_SEVERITY, F.col("_pri").bitwiseAND(F.lit(7)).cast("int"))
    facility = _named(SYSLOG_FACILITY, F.least(F.shiftright("_pri", 3), F.lit(len(SYSLOG_FACILITY))).cast("int"))
    message = F.when(k == "RFC5424", g5(9)).when(k == "RFC3164", g3(7)).otherwise(line)

    new_style = _entries(
        {
            "facility": facility,
            "hostname": g5(4),
            "procid": g5(6),
            "msgid": g5(7),
            "structured_data": g5(8),
            "version": g5(2),
            "format": F.lit("RFC5424"),
        }
    )
    body = g3(7)
    json_body = body.startswith("{") & body.endswith("}")
    old_style = _entries(
        {
            "facility": facility,
            "hostname": g3(3),
            "format": F.lit("RFC3164"),
            "pid": F.nullif(g3(6), F.lit("")),
            "raw_message": F.when(json_body, body),
        }
    )
    attributes = (
        F.when(k == "RFC5424", new_style)
        .when(k == "RFC3164", old_style)
        .otherwise(_entries({"format": F.lit("unknown")}))
    )
    if source_column is not None:
        attributes = F.map_concat(attributes, _entries({"source_addr": F.col(source_column)}))
    stamp = F.when(k == "RFC5424", parse_rfc3339(g5(3))).when(
        k == "RFC3164", parse_yearless(F.regexp_replace(g3(2), r"\s+", " "), as_of.year)
    )
    decoded = staged.select(
        *others,
        F.coalesce(stamp, ntz(as_of)).alias("timestamp"),
        F.when(k == "unknown", F.lit("info")).otherwise(severity).alias("level"),
        message.alias("message"),
        F.when(k == "RFC5424", g5(5)).when(k == "RFC3164", g3(4)).otherwise(F.lit("syslog")).alias("service"),
        F.lit("").alias("trace_id"),
        F.lit("").alias("span_id"),
        attributes.alias("attributes"),
    )
    return decoded.withColumn("attributes", present_attributes())
