"""Maximal periodic runs of words, found by exact block correlation at dyadic scales."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.llm.common import runs as text_runs
from ridgelog.llm.ntt import LONGEST, squared_differences

#: a run has so many words at least, and so many periods
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: numbers in the transforms of one call
_CELLS = 1 << 18
#: up to so many places a distance are extended one by one
_FEW = 4
_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _next_same(ids: np.ndarray) -> np.ndarray:
    """The distance from every word to the next equal one; the number of words where there is none."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids), np.int64)
    same = ids[order[:-1]] == ids[order[1:]]
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


class _Finder:
    """The runs in a row of texts: ``ids`` are their words one after the other, different in different texts."""

    def __init__(self, ids: np.ndarray, local: np.ndarray, ends: np.ndarray):
        # local: small numbers of the words within their text; ends: behind each word's text
        self.ids, self.local, self.ends = ids, local, ends
        self.found: dict[tuple[int, int], int] = {}
        # for every word the end and period of a known run it lies in; of several, one of the shortest period
        self.covered = np.zeros(len(ids), np.int64)
        self.period = np.zeros(len(ids), np.int64)

    def search(self) -> dict[tuple[int, int], int]:
        """``(start, end) -> period`` of all runs."""
        gap, block = _next_same(self.ids), 1
        longest = int((self.ends - np.arange(len(self.ids))).max(initial=0))
        while LEAST_PERIODS * block <= longest:
            self._scale(block, gap)
            block *= 2
        return self.found

    def _scale(self, block: int, gap: np.ndarray) -> None:
        """Runs with a period from ``block`` to ``2 block - 1``: the first whole block in such a run occurs again one period later."""
        if 2 * block > LONGEST:
            raise ValueError("a text has too many words")
        starts = np.arange(0, len(self.ids) - 2 * block + 1, block)
        # a block in a run occurs again within its window only if each of its words does; so it is with the block behind it
        near = np.maximum.reduceat(gap, np.arange(0, len(gap), block))[: len(starts) + 1] < 2 * block
        starts = starts[near[: len(starts)] & near[1 : len(starts) + 1]]
        starts = starts[self.ends[starts] >= starts + 3 * block]
        # deep in a run of a shorter period a block occurs at multiples of that period only, which give the same run
        deep = (self.period[starts] > 0) & (self.period[starts] <= block) & (self.covered[starts] >= starts + 3 * block)
        starts = starts[~deep]
        seeds = []
        step = max(1, _CELLS // (2 * block))
        for k in range(0, len(starts), step):
            own = starts[k : k + step]
            at = own[:, None] + np.arange(3 * block)
            inside = at < self.ends[own][:, None]
            values = np.where(inside, self.local[np.minimum(at, len(self.local) - 1)] + 1, 0)  # 0: behind the text
            row, shift = np.nonzero(squared_differences(values[:, :block], values[:, block:]))
            seeds.append(np.stack([shift + block, own[row]]))
        distance, place = np.concatenate(seeds, axis=1) if seeds else np.zeros((2, 0), np.int64)
        if len(distance):
            order = np.lexsort((place, distance))
            distance, place = distance[order], place[order]
            cuts = np.flatnonzero(np.diff(distance)) + 1
            for d, group in zip(distance[np.concatenate([[0], cuts])], np.split(place, cuts)):
                self._extend(int(d), group, block)

    def _extend(self, d: int, places: np.ndarray, block: int) -> None:
        """The longest stretches of period ``d`` around blocks that occur again at that distance."""
        known = self.period[places] > 0
        known &= (d % np.maximum(self.period[places], 1) == 0) & (self.covered[places] >= places + d + block)
        places = places[~known]
        if len(places) > _FEW:
            low, high = self._reach(d, int(places[0]), block)[0], self._reach(d, int(places[-1]), block)[1]
            high = max(high, int(places[-1]) + block + d)
            same = self.ids[low : high - d] == self.ids[low + d : high]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
            begins, stops = turns[::2] + low, turns[1::2] + low
            which = np.unique(np.searchsorted(begins, places, "right") - 1)
            stretches = [(int(begins[k]), int(stops[k]) + d) for k in which]
        else:
            stretches, last = [], -1
            for place in places.tolist():
                if place >= last:
                    start, end = self._reach(d, place, block)
                    stretches.append((start, end))
                    last = end - d
        for start, end in stretches:
            length = end - start
            # a stretch that is known has a shorter period
            if length >= max(LEAST_WORDS, LEAST_PERIODS * d) and (start, end) not in self.found:
                self.found[start, end] = d
                fresh = self.period[start:end] == 0
                self.period[start:end][fresh], self.covered[start:end][fresh] = d, end

    def _reach(self, d: int, place: int, block: int) -> tuple[int, int]:
        """The longest stretch of period ``d`` around the block; steps double while all words agree."""
        ids = self.ids
        right, step = place + block, 64
        while right + d < len(ids):
            n = min(step, len(ids) - d - right)
            differ = np.flatnonzero(ids[right : right + n] != ids[right + d : right + d + n])
            if len(differ):
                right += int(differ[0])
                break
            right, step = right + n, step * 2
        left, step = place, 64
        while left > 0:
            n = min(step, left)
            differ = np.flatnonzero(ids[left - n : left] != ids[left - n + d : left + d])
            if len(differ):
                left -= n - 1 - int(differ[-1])
                break
            left, step = left - n, step * 2
        return left, right + d


def periodic_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each text, by start and period; a text is an array of word numbers.

    The texts are searched together, so that short ones share the transforms.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return [[] for _ in texts]
    owner, words = np.repeat(np.arange(len(texts)), sizes), np.concatenate(texts).astype(np.int64)
    keys = owner * (int(words.max()) + 1) + words
    _, ids = np.unique(keys, return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    lowest = np.minimum.reduceat(ids, begin[sizes > 0])  # keys rise from text to text
    spread = np.zeros(len(texts), np.int64)
    spread[sizes > 0] = lowest
    found = _Finder(ids, ids - spread[owner], (begin + sizes)[owner]).search()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, end), d in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
        k = int(owner[start])
        out[k].append((start - int(begin[k]), end - start, d))
    return out


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, with a periodic tail if the checksum of its id ends in 0; without an id they stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def _kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _report(doc_ids: list, texts: list[list[bytes]], found: list[list[tuple[int, int, int]]]) -> list[tuple]:
    out = []
    for doc_id, words, own in zip(doc_ids, texts, found):
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
        start, length, period = best or (None, None, None)
        listed = hashlib.sha256("".join(f"{s},{z},{q}\n" for s, z, q in own).encode()).hexdigest()
        kept = words if not own else [words[i] for i in np.flatnonzero(_kept(len(words), own))]
        out.append((doc_id, len(own), start, length, period, 1000 * length // period if best else None, listed, hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def _numbers(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def run_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """The periodic runs of every row's whole text in a digest, one row each.

    ``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)``: how many runs, the longest of them
    (of equally long ones that which starts first, then the one with the shorter period), the digest of all, and that of the text without the repetitions.
    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and no runs; the digests are those of the empty
    text then. Repeated rows stay, a null doc_id stays null; other columns are not read; an empty table gives no rows.
    Rows are independent: no shuffle, and beside the Arrow batch about a megabyte of text is taken apart at a time, or one long text.
    ``plant`` gives one text in ten a periodic tail first (see ``planted``).
    """

    def search(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            rows = []
            for start, stop in text_runs(texts, 1 << 19):
                words = [(t or b"").split() for t in texts.slice(start, stop - start).to_pylist()]
                if plant:
                    words = [planted(i, w) for i, w in zip(ids[start:stop], words)]
                known: dict[bytes, int] = {}
                rows += _report(ids[start:stop], words, periodic_runs([_numbers(w, known) for w in words]))
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _SCHEMA.split(", ")]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(search, _SCHEMA)


def collapsed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repetitions of every run taken out of the text, words joined by one space; texts without a run stay as they are.

    All other columns stay. Null texts stay null.
    """
    kind = docs.schema[text].dataType

    def search(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, out = batch.column(at).cast(pa.binary()), []
            for start, stop in text_runs(texts, 1 << 19):
                given = texts.slice(start, stop - start).to_pylist()
                words, known = [(t or b"").split() for t in given], {}
                found = periodic_runs([_numbers(w, known) for w in words])
                out += [t if not own else b" ".join([w[i] for i in np.flatnonzero(_kept(len(w), own))]) for t, w, own in zip(given, words, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()).cast(batch.schema.field(at).type))

    if kind.simpleString() != "string":
        raise TypeError(f"{text} is no text column")
    return docs.mapInArrow(search, docs.schema)
