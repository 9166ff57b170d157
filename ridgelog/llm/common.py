"""Helpers that several operators share: words, keys, size-checked broadcasts, global positions."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: everything in ASCII that is neither a letter nor a digit, after lower-casing
_NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is.

    ``lower`` does that for ASCII texts and is much faster than ``translate``;
    a text is ASCII if it has as many bytes as characters.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def alnum_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and any non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_ALNUM), "")


def row_keys(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two numbers that rows share only if they have the same doc_id and text; neither is ever null."""
    n = F.col(doc_id).cast("long")
    return F.coalesce(n, F.lit(0)), F.xxhash64(n.isNull(), F.col(text).isNull(), F.col(text).cast("string"))


def broadcast_if_small(frame: DataFrame, rows: int, most: int) -> DataFrame:
    """``frame`` with a broadcast hint if its known number of ``rows`` is within ``most``; else as it is."""
    return F.broadcast(frame) if rows <= most else frame


def fresh(taken, name: str) -> str:
    """``name``, lengthened until no column of ``taken`` is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def bands_for(jaccard: float, miss: float) -> int:
    """Single-row MinHash bands of which at least one collides but for a chance of ``miss``."""
    return 1 if jaccard >= 1 else math.ceil(math.log(miss) / math.log(1 - jaccard))


def runs(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of about ``most`` bytes of text; a longer text is a run of its own.

    An Arrow batch holds thousands of texts; taken run by run, only a small part of
    them stands in memory as Python objects.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def by_runs(texts: pa.Array, most: int = 1 << 20) -> Iterator[str | None]:
    """The texts as Python strings, made run by run."""
    for start, stop in runs(texts, most):
        yield from texts.slice(start, stop - start).to_pylist()
