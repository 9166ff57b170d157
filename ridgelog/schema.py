"""The ``logs`` record and its fixed vocabularies."""

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)

LOG_FIELDS = tuple(LOG_SCHEMA.fieldNames())
#: core fields other than the timestamp, all strings, '' when missing
TEXT_FIELDS = ("message", "level", "service", "trace_id", "span_id")
#: fields a declarative query may name
QUERY_FIELDS = ("id", "timestamp", "level", "message", "service", "trace_id", "span_id")

# fixed values: numeric rank of the five stored levels, anything else is 0
LEVEL_RANK = {"debug": 1, "info": 2, "warn": 3, "error": 4, "fatal": 5}

#: levels that make a log count as an error in rollups and traces
FAILURE_LEVELS = ("error", "fatal")
