"""Timestamps in free text.

One pattern decides whether a text has a layout; the text is then rearranged to
ISO form and cast. The cast rejects impossible dates and times. A fraction of
the second may follow in every layout, after a point or a comma.
"""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgelog.functions.scalars import _col

_CLOCK = r"\d{1,2}:[0-5]\d:[0-5]\d(?:[.,]\d+)?"
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"

# fixed values: the accepted layouts
ISO_ZONED = rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})\z"
ISO_PLAIN = rf"^\d{{4}}-\d{{2}}-\d{{2}} {_CLOCK}\z"
SLASHED = rf"^\d{{4}}/\d{{2}}/\d{{2}} {_CLOCK}\z"
YEARLESS = rf"^(?i){_MONTH} +\d{{1,2}} {_CLOCK}\z"
ACCESS_LOG = rf"^(?i)\d{{2}}/{_MONTH}/\d{{4}}:{_CLOCK} [+-]\d{{4}}\z"
UNIX = r"^[+-]?\d+\z"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
LARGEST_SECONDS = 1_000_000_000_000


def _moment(text: Column) -> Column:
    """Cast 'yyyy-mm-dd hh:mm:ss,fraction' to a zone-free timestamp, null when impossible."""
    return F.translate(text, ",/", ".-").try_cast("timestamp_ntz")


def _month_number(name: Column) -> Column:
    number = ((F.instr(F.lit(MONTHS), F.lower(name)) + 2) / 3).cast("int")
    return F.lpad(number.cast("string"), 2, "0")


def _to_utc(local: Column, offset: Column) -> Column:
    """Subtract an offset of the form +hh:mm or +hhmm."""
    digits = F.translate(offset, ":+-", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    signed = F.when(offset.startswith("-"), -minutes).otherwise(minutes)
    return local - F.make_dt_interval(F.lit(0), F.lit(0), signed)


def _without_last(text: Column, n: int) -> Column:
    return F.left(text, F.length(text) - n)


def parse_rfc3339(text) -> Column:
    """'2024-01-15T10:30:00.123Z' or with an offset, in UTC."""
    text = _col(text)
    zulu = _moment(F.translate(_without_last(text, 1), "T", " "))
    shifted = _to_utc(_moment(F.translate(_without_last(text, 6), "T", " ")), F.right(text, F.lit(6)))
    return F.when(text.rlike(ISO_ZONED), F.when(text.endswith("Z"), zulu).otherwise(shifted))


def _plain(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), _moment(text))


def parse_json_timestamp(text) -> Column:
    """The three layouts of a JSON log; null when none fits."""
    text = _col(text)
    return F.coalesce(parse_rfc3339(text), _plain(text, ISO_PLAIN))


def parse_yearless(text, year: int) -> Column:
    """'Jan  2 15:04:05' in the given year."""
    text = _col(text)
    parts = F.split(text, " +")
    day = F.lpad(parts[1], 2, "0")
    iso = F.concat(F.lit(f"{year:04d}-"), _month_number(F.left(text, F.lit(3))), F.lit("-"), day, F.lit(" "), parts[2])
    return F.when(text.rlike(YEARLESS), _moment(iso))


def _access_log(text: Column) -> Column:
    """'15/Jan/2024:10:30:00 +0100' in UTC."""
    date = F.concat(
        F.substring(text, 8, 4), F.lit("-"), _month_number(F.substring(text, 4, 3)), F.lit("-"), F.left(text, F.lit(2))
    )
    clock = F.substring(_without_last(text, 6), 13, 40)
    local = _moment(F.concat(date, F.lit(" "), clock))
    return F.when(text.rlike(ACCESS_LOG), _to_utc(local, F.right(text, F.lit(5))))


def _unix(text: Column) -> Column:
    """Seconds, or milliseconds above 1e12; null for a moment that no timestamp can hold."""
    number = text.try_cast("bigint")
    micros = F.when(number > LARGEST_SECONDS, F.try_multiply(number, F.lit(1000))).otherwise(F.try_multiply(number, F.lit(1_000_000)))
    return F.when(text.rlike(UNIX), F.timestamp_micros(micros).cast("timestamp_ntz"))


def parse_timestamp(text, as_of: datetime) -> Column:
    """ISO, slashed, syslog and access-log layouts, then Unix seconds or milliseconds.

    A layout without a year takes the year of ``as_of``. Null when nothing fits.
    """
    text = _col(text)
    return F.coalesce(
        parse_json_timestamp(text),
        _plain(text, SLASHED),
        parse_yearless(text, as_of.year),
        _access_log(text),
        _unix(text),
    )
