"""Scalar column helpers shared by the operators."""

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelog.schema import LEVEL_RANK

# fixed values: the Unicode white space that a trim removes
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# fixed values: binary size units
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ntz(value: datetime | str) -> Column:
    """A zone-free timestamp literal, so that filters on it reach the scan."""
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def before(as_of: datetime, **span) -> Column:
    """``as_of`` minus a span such as ``hours=24``, as a literal."""
    return ntz(as_of - timedelta(**span))


def trim_space(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def apart(column: Column) -> Column:
    """The column unchanged, computed apart from its stage's generated code.

    Spark turns the projections of a stage into one method, and the JVM interprets a method of more than 8000 bytecodes forever.
    A projection with a lambda is generated by itself, in small methods; so one such column keeps a long projection fast.
    """
    return F.element_at(F.transform(F.array(F.lit(0)), lambda _: column), 1)


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated once per row.

    The optimizer repeats an expression in every place that uses it: pushed-down
    filters, fields of a struct. It does not look through a generator, so a
    one-element ``explode`` keeps the column in one place.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def compact_texts(texts: Sequence[Column]) -> Column:
    """Array of the texts that are not null, without a lambda.

    A lambda function evaluates its whole input outside of generated code, so
    costly inputs are joined and split instead. The texts must not be empty nor
    contain the separator, a control character.
    """
    return F.array_remove(F.split(F.concat_ws("\x01", *texts), "\x01"), "")


def attr(name: str, attributes="attributes") -> Column:
    """One attribute as text, '' when the key is missing."""
    return F.coalesce(_col(attributes)[name], F.lit(""))


def has_attr(name: str, attributes="attributes") -> Column:
    return _col(attributes)[name].isNotNull()


def attr_double(name: str, attributes="attributes") -> Column:
    return attr(name, attributes).try_cast("double")


def attr_long(name: str, attributes="attributes") -> Column:
    return attr(name, attributes).try_cast("bigint")


def present_attributes(attributes="attributes") -> Column:
    """The attribute map without its null entries (null means the key is missing)."""
    return F.map_filter(_col(attributes), lambda _, v: v.isNotNull())


def merge_maps(base, over) -> Column:
    """Union of two maps; ``over`` wins on a common key."""
    base, over = _col(base), _col(over)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def start_of_minute(ts) -> Column:
    return F.date_trunc("minute", _col(ts)).cast("timestamp_ntz")


def start_of_hour(ts) -> Column:
    return F.date_trunc("hour", _col(ts)).cast("timestamp_ntz")


def start_of_second(ts) -> Column:
    return F.date_trunc("second", _col(ts)).cast("timestamp_ntz")


def interval_bucket(ts, minutes: int) -> Column:
    """Grouping key: start of the epoch-aligned interval of ``minutes``.

    For use in ``groupBy``, in batch and on streams.
    """
    return F.window(_col(ts), f"{int(minutes)} minutes")


def epoch_micros(ts) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def epoch_millis(ts) -> Column:
    return F.unix_millis(_col(ts).cast("timestamp"))


def seconds_between(start, end) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1e6)


def from_epoch_micros(micros) -> Column:
    return F.timestamp_micros(_col(micros)).cast("timestamp_ntz")


def day(ts) -> Column:
    return F.to_date(_col(ts))


def hour(ts) -> Column:
    return F.hour(_col(ts))


def partition_key(ts, interval: str = "daily") -> Column:
    """Partition value: yyyyMMdd, ISO yyyyWW, yyyyMM or yyyyMMddHH.

    Weeks follow ISO 8601 with the ISO year, so the days around New Year stay
    in one partition.
    """
    ts = _col(ts)
    if interval == "weekly":
        return F.concat(
            F.date_part(F.lit("YEAROFWEEK"), ts).cast("string"),
            F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
        )
    formats = {"daily": "yyyyMMdd", "monthly": "yyyyMM", "hourly": "yyyyMMddHH"}
    return F.date_format(ts, formats.get(interval, "yyyyMMdd"))


def level_rank(level) -> Column:
    rank = F.lit(0)
    for name, number in LEVEL_RANK.items():
        rank = F.when(_col(level) == name, F.lit(number)).otherwise(rank)
    return rank


def contains_ignore_case(text, term: str) -> Column:
    """Literal, case-insensitive substring test (no wildcards)."""
    return F.lower(_col(text)).contains(term.lower())


def byte_length(text) -> Column:
    return F.octet_length(_col(text))


def readable_size(size) -> Column:
    """1536 -> '1.50 KiB'."""
    size = _col(size).cast("double")
    text = F.format_string("%.2f " + SIZE_UNITS[0], size)
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        scale = float(1024**power)
        text = F.when(size >= scale, F.format_string("%.2f " + unit, size / scale)).otherwise(text)
    return text


def first_words(text, n: int = 3) -> Column:
    """The first ``n`` white-space separated words, joined by one space."""
    words = F.split(trim_space(text), r"(?U)\s+")
    return F.array_join(F.slice(words, 1, n), " ")


def short_number(value) -> Column:
    """Display form of a metric: 1.2K, 3.4M, else up to three decimals."""
    v = _col(value).cast("double")
    plain = F.regexp_replace(F.format_number(F.round(v, 3), 3), r"\.?0+$", "")
    return (
        F.when(v >= 1e6, F.format_string("%.1fM", v / 1e6))
        .when(v >= 1e3, F.format_string("%.1fK", v / 1e3))
        .otherwise(plain)
    )


def json_field(text, path: str) -> Column:
    return F.get_json_object(_col(text), path)
