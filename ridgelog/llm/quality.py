"""Quality rules: statistics of whole texts and an isolation forest over them."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.llm.common import by_runs, fresh
from ridgelog.llm.iforest import IsolationForest, fit

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = ids[:-2] * _MIX[0] ^ ids[1:-1] * _MIX[1] ^ ids[2:] * _MIX[2]
    windows ^= windows >> np.uint64(31)
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    again = np.zeros(n, bool)
    for places in (order[1:][equal], order[:-1][equal]):
        again[places] = again[places + 1] = again[places + 2] = True
    return int(again.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; null counts as empty.

    Words are runs without ASCII white space. A line is what lies between ``\\n``; lines
    without a word are not counted, and a duplicate equals an earlier line character by character.
    """
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), _repeated_words(words), len(lines)


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def rule_statistics(counts: np.ndarray) -> np.ndarray:
    """What the forest sees of a text: rates that do not depend on its length.

    Symbols per word, length of words, and the shares of duplicate lines and repeated words.
    """
    counts = counts.astype(float)
    words, lines = np.maximum(counts[:, 0], 1), np.maximum(counts[:, 5], 1)
    return np.column_stack([np.log1p(50 * counts[:, 2] / words), np.log1p(counts[:, 1] / words), counts[:, 3] / lines, counts[:, 4] / words])


@dataclass(frozen=True)
class RuleModel:
    """A fitted forest and the score above which a text is rejected; without a forest only the base rules decide."""

    forest: IsolationForest | None
    threshold: float

    def accepts(self, counts: np.ndarray) -> np.ndarray:
        kept = ~base_failed(counts)
        if self.forest is not None and kept.any():
            kept[kept] = self.forest.scores(rule_statistics(counts[kept])) <= self.threshold
        return kept


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the best balanced accuracy on labelled scores, half-way to the next score.

    Without bad rows, nothing that scores like a good row is rejected.
    """
    if good.all():
        return float(scores.max())
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    balanced = np.cumsum(good) / good.sum() - np.cumsum(~good) / (~good).sum()
    last = np.r_[scores[1:] > scores[:-1], True]  # a threshold cannot part equal scores
    at = int(np.argmax(np.where(last, balanced, -2)))
    return float((scores[at] + scores[min(at + 1, len(scores) - 1)]) / 2)


def train_rules(counts: np.ndarray, good: np.ndarray, trees: int = 100, sample: int = 1024, seed: int = 42) -> RuleModel:
    """A forest of the good rows that pass the base rules, calibrated against all rows that pass them."""
    passed = ~base_failed(counts)
    rows, good = rule_statistics(counts[passed]), good[passed]
    if not good.any():
        return RuleModel(None, 1.0)
    forest = fit(rows[good], rows.min(axis=0), rows.max(axis=0), trees, sample, seed)
    return RuleModel(forest, calibrate(forest.scores(rows), good))


def _all_counts(texts: pa.Array) -> np.ndarray:
    return np.array([text_counts(t) for t in by_runs(texts)], np.int64).reshape(-1, len(COUNTS))


def _counts_udf():
    @F.arrow_udf(f"struct<{','.join(f'{c}:long' for c in COUNTS)}>")
    def counts(text: pa.Array) -> pa.Array:
        rows = _all_counts(text)
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], list(COUNTS))

    return counts


def fit_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample_rows: int = 20_000) -> RuleModel:
    """A model fitted on at most ``sample_rows`` labelled documents, those with the smallest hashes of their doc_id.

    ``labels`` has 1 for good and 0 for bad documents; other values, nulls and documents that
    are not in ``docs`` are left out; a document with both labels counts as bad. The
    sample is the only data that reaches the driver. Without good documents
    only the base rules decide.
    """
    marks = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.min(F.col(quality).cast("int")).alias("good"))
    marks = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text")).join(marks, "_id")
    found = rows.select("_id", "good", _counts_udf()("text").alias("c")).groupBy("_id", "good").agg(F.min(F.array(*[f"c.{c}" for c in COUNTS])).alias("c")).collect()
    found.sort(key=lambda r: r["_id"])
    counts = np.array([r["c"] for r in found], np.int64).reshape(-1, len(COUNTS))
    return train_rules(counts, np.array([r["good"] == 1 for r in found], bool))


def judge_quality(docs: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` for every row.

    A text that fails the base rules is not kept; any other is kept unless the forest finds its
    statistics anomalous. A null text has no words and fails. Rows are independent, so
    repeated rows and null doc_ids stay as they are; other columns are not read.
    """
    kinds = ",".join(f"{c}:long" for c in COUNTS[:5])

    @F.arrow_udf(f"struct<{kinds},base_failed:boolean,kept:boolean>")
    def judged(text: pa.Array) -> pa.Array:
        rows = _all_counts(text)
        columns = [pa.array(rows[:, k]) for k in range(5)] + [pa.array(base_failed(rows)), pa.array(model.accepts(rows))]
        return pa.StructArray.from_arrays(columns, [*COUNTS[:5], "base_failed", "kept"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), judged(F.col(text).cast("string")).alias("j"))
    return rows.select("doc_id", "j.*")


def accepted(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules accept."""
    mark = fresh(docs.columns, "_accepted")

    @F.arrow_udf("boolean")
    def accept(text: pa.Array) -> pa.Array:
        return pa.array(model.accepts(_all_counts(text)))

    return docs.withColumn(mark, accept(F.col(text).cast("string"))).where(F.col(mark)).drop(mark)
