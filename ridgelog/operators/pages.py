"""Offset and keyset pages."""

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000


@dataclass(frozen=True)
class PageRequest:
    page_size: int = 0
    page_token: str = ""
    sort_by: str = ""
    sort_order: str = ""


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    page_size: int
    has_more: bool
    next_page_token: str = ""
    prev_page_token: str = ""


def encode_token(**cursor: Any) -> str:
    return base64.urlsafe_b64encode(json.dumps(cursor, default=str).encode()).decode()


def decode_token(token: str) -> dict[str, Any]:
    try:
        cursor = json.loads(base64.urlsafe_b64decode(token.encode()))
    except ValueError as error:
        raise ValueError(f"unreadable page token: {error}") from error
    if not isinstance(cursor, dict):
        raise ValueError("unreadable page token")
    return cursor


def normalise(request: PageRequest) -> PageRequest:
    """Default and maximum page size, default order DESC, checked token."""
    size = min(request.page_size if request.page_size > 0 else DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE)
    order = (request.sort_order or "DESC").upper()
    if order not in ("ASC", "DESC"):
        raise ValueError(f"sort order must be ASC or DESC, not {request.sort_order}")
    if request.page_token:
        decode_token(request.page_token)
    return replace(request, page_size=size, sort_order=order)


def _sorted_by(columns: Sequence[str], order: str) -> list[Column]:
    return [F.col(c).asc() if order == "ASC" else F.col(c).desc() for c in columns]


def _offset(request: PageRequest) -> int:
    return int(decode_token(request.page_token).get("offset", 0)) if request.page_token else 0


def offset_rows(df: DataFrame, request: PageRequest, tie: str = "id") -> DataFrame:
    """The rows of one page plus one more, which tells whether a next page exists.

    Top-k per task plus a merge: good for the first pages. Every page reads all
    pages before it, so deep reading should use ``keyset_rows``.
    """
    request = normalise(request)
    if request.sort_by:
        df = df.orderBy(*_sorted_by((request.sort_by, tie), request.sort_order))
    return df.offset(_offset(request)).limit(request.page_size + 1)


def offset_page(df: DataFrame, request: PageRequest, tie: str = "id") -> Page:
    """Fetch one page (at most ``MAX_PAGE_SIZE + 1`` rows reach the driver)."""
    request = normalise(request)
    rows = offset_rows(df, request, tie).collect()
    offset, size = _offset(request), request.page_size
    return Page(
        rows=rows[:size],
        page_size=size,
        has_more=len(rows) > size,
        next_page_token=encode_token(offset=offset + size) if len(rows) > size else "",
        prev_page_token=encode_token(offset=max(0, offset - size)) if offset > 0 else "",
    )


def keyset_rows(
    df: DataFrame,
    key: str,
    last: tuple[Any, Any] | None,
    page_size: int,
    order: str = "DESC",
    tie: str = "id",
) -> DataFrame:
    """Rows after the last seen (key, tie) pair, plus one more.

    The plain bound on ``key`` is pushed into the scan, and a bound on the time
    also prunes the days of a stored table. The pair test then removes the rows
    of the page border, so ties are neither lost nor repeated.
    """
    if last is not None:
        if key == "timestamp" and "date_partition" in df.columns:
            day = F.to_date(F.lit(str(last[0])))
            df = df.filter(F.col("date_partition") >= day if order == "ASC" else F.col("date_partition") <= day)
        key_value = F.lit(last[0]).cast(df.schema[key].dataType)
        tie_value = F.lit(last[1]).cast(df.schema[tie].dataType)
        k, t = F.col(key), F.col(tie)
        if order == "ASC":
            df = df.filter(k >= key_value).filter((k > key_value) | (t > tie_value))
        else:
            df = df.filter(k <= key_value).filter((k < key_value) | (t < tie_value))
    return df.orderBy(*_sorted_by((key, tie), order)).limit(page_size + 1)


def keyset_page(df: DataFrame, key: str, request: PageRequest, tie: str = "id") -> Page:
    request = normalise(request)
    last = tuple(decode_token(request.page_token)["sort_value"]) if request.page_token else None
    rows = keyset_rows(df, key, last, request.page_size, request.sort_order, tie).collect()
    page = rows[: request.page_size]
    more = len(rows) > request.page_size
    token = encode_token(sort_value=[str(page[-1][key]), str(page[-1][tie])]) if more else ""
    return Page(rows=page, page_size=request.page_size, has_more=more, next_page_token=token)


def total_count(df: DataFrame) -> DataFrame:
    """Exact number of rows over all pages, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("total_count"))
