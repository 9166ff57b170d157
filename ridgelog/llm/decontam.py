"""Benchmark decontamination: a positional inverted index, searched from the rarest benchmark words."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgelog.llm.common import alnum_words, broadcast_if_small, fresh, row_keys
from ridgelog.session import checkpointed

#: words of a window
WINDOW = 10
#: rows of a table of words, windows or documents that is broadcast whole; beyond it words are looked up in
#: several passes, and the other joins shuffle
BROADCAST_MOST = 200_000
#: places of a block in which starts and postings meet
BLOCK = 64
_PLACE = ["id_key", "text_key"]


@dataclass(frozen=True)
class Benchmark:
    """The different windows of a benchmark ``(window, size, item_ids)`` and their words ``(window, at, word)``, stored."""

    windows: DataFrame
    placed: DataFrame
    words: DataFrame
    n_windows: int
    n_words: int


def read_benchmark(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> Benchmark:
    """The windows of all items: every run of ``window`` words, or the whole item if it has fewer.

    Items without words, null texts included, have no window. Items without an id
    keep their windows and are in no list; a repeated item is one item.
    """
    rows = items.select(F.col(item_id).alias("item_id"), alnum_words(F.col(text).cast("string")).alias("all_words")).where(F.size("all_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all_words") - window + 1, F.lit(1)))
    cut = rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all_words", s, window))).alias("words"))
    windows = cut.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("window", F.monotonically_increasing_id())
    windows = checkpointed(windows, "benchmark-windows")
    written = windows.select("window", F.posexplode("words").alias("at", "written"))
    words = checkpointed(written.select("written").distinct().withColumn("word", F.monotonically_increasing_id()), "benchmark-words")
    placed = checkpointed(written.join(words, "written").select("window", "at", "word"), "benchmark-places")
    return Benchmark(windows.select("window", F.size("words").alias("size"), "item_ids"), placed, words, windows.count(), words.count())


def build_index(docs: DataFrame, benchmark: Benchmark, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index ``(word, place, id_key, text_key, doc_id)``: every occurrence of a benchmark word in any document.

    Other words cannot take part in a match. Behind the words of a document comes a row
    with a null word whose place is their number. Texts are read once (or once for each
    BROADCAST_MOST benchmark words, if there are more); nothing is shuffled.
    """
    id_key, text_key = row_keys(doc_id, text)
    words = F.array_append(alnum_words(F.col(text).cast("string")), F.lit(None).cast("string"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), id_key.alias("id_key"), text_key.alias("text_key"), F.posexplode(words).alias("place", "found"))
    passes, index = max(1, math.ceil(benchmark.n_words / BROADCAST_MOST)), None
    for k in range(passes):
        known = F.broadcast(benchmark.words.where(F.pmod(F.xxhash64("written"), F.lit(passes)) == k))
        part = rows.join(known, F.col("found") == F.col("written"), "left").where("word IS NOT NULL" if k else "word IS NOT NULL OR found IS NULL")
        part = part.select("word", "place", "id_key", "text_key", "doc_id")
        index = part if index is None else index.union(part)
    return checkpointed(index, "postings")


def rarest_words(index: DataFrame, benchmark: Benchmark) -> DataFrame:
    """``(window, size, first, first_at, second, second_at, third, third_at)``: the rarest words of each window by their postings.

    A window with a word that no document has cannot occur and is left out. A window of one word has no second, one of two no third.
    """
    counts = index.where("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = benchmark.placed.join(broadcast_if_small(counts, benchmark.n_words, BROADCAST_MOST), "word", "left")
    ranked = known.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "word", "at"))).alias("r"), F.count(F.lit(1)).alias("size"))
    some = [(name, F.try_element_at("r", F.lit(k + 1))) for k, name in enumerate(("first", "second", "third"))]
    return ranked.where(F.size(F.filter("r", lambda x: x["n"].isNull())) == 0).select(
        "window", "size", *[c for name, x in some for c in (x["word"].alias(name), x["at"].alias(f"{name}_at"))]
    )


def _listed(index: DataFrame, benchmark: Benchmark, rare: DataFrame, name: str) -> DataFrame:
    """The postings of the words that are ``name`` (second, third) in some window."""
    words = rare.where(F.col(name).isNotNull()).select(F.col(name).alias("word")).distinct()
    postings = index.where("word IS NOT NULL").select("word", "place", *_PLACE)
    return postings.join(broadcast_if_small(words, benchmark.n_words, BROADCAST_MOST), "word", "left_semi")


def _within(rows: DataFrame, postings: DataFrame, low: Column, slop: int) -> DataFrame:
    """``rows`` (with ``word`` and the document) with each ``place`` of the word from ``low`` to ``low + slop``.

    Both sides meet in blocks of BLOCK places; a row whose places reach into the next block is there twice.
    """
    block = F.explode(F.sequence(F.floor(low / BLOCK), F.floor((low + slop) / BLOCK)))
    listed = postings.select("*", F.floor(F.col("place") / BLOCK).alias("block")).distinct()
    wanted = rows.select("*", low.alias("least"), block.alias("block"))
    return wanted.join(listed, [*_PLACE, "word", "block"]).where(F.col("place").between(F.col("least"), F.col("least") + slop)).drop("block", "least", "word")


def candidate_starts(index: DataFrame, benchmark: Benchmark, rare: DataFrame, slop: int = 0) -> DataFrame:
    """``(id_key, text_key, window, size, start, other)``, stored: where the two rarest words of a window agree.

    The postings of the rarest word, moved back by its place in the window, say where the window
    could start; ``other`` is such a start of the second rarest word, at most ``slop`` away. A window of one word has ``other = start``.
    """
    postings = index.where("word IS NOT NULL").select("word", "place", *_PLACE)
    starts = postings.join(broadcast_if_small(rare, benchmark.n_windows, BROADCAST_MOST), F.col("word") == F.col("first"))
    starts = starts.select(*_PLACE, "window", "size", (F.col("place") - F.col("first_at")).alias("start"), "second", "second_at").distinct()
    starts = starts if slop else starts.where("start >= 0")
    wanted, listed = starts.where("second IS NOT NULL").withColumnRenamed("second", "word"), _listed(index, benchmark, rare, "second")
    if slop:
        both = _within(wanted, listed, F.col("start") + F.col("second_at") - slop, 2 * slop).withColumn("other", F.col("place") - F.col("second_at"))
    else:
        both = wanted.withColumn("place", F.col("start") + F.col("second_at")).join(listed, [*_PLACE, "place", "word"], "left_semi").withColumn("other", F.col("start"))
    names = [*_PLACE, "window", "size", "start", "other"]
    return checkpointed(both.select(names).unionByName(starts.where("second IS NULL").withColumn("other", F.col("start")).select(names)), "starts")


def phrase_matches(index: DataFrame, benchmark: Benchmark, starts: DataFrame | None = None) -> DataFrame:
    """``(id_key, text_key, window, start, size)``: every occurrence of a window in a document.

    Of the starts that the postings of a window's two rarest words share (``starts``, if
    ``candidate_starts`` has been stored), those are kept that have a posting for every word.
    Every step is an equi-join on (document, place, word), so no list is ever
    gathered, however common a word.
    """
    postings = index.where("word IS NOT NULL").select("word", "place", *_PLACE)
    if starts is None:
        starts = candidate_starts(index, benchmark, checkpointed(rarest_words(index, benchmark), "benchmark-rarest"))
    both = starts.where("start = other AND start >= 0")
    docs = checkpointed(both.select(*_PLACE).distinct(), "candidates")
    near = postings.join(broadcast_if_small(docs, docs.count(), BROADCAST_MOST), _PLACE, "left_semi")
    wanted = both.join(broadcast_if_small(benchmark.placed, benchmark.n_windows * WINDOW, BROADCAST_MOST * WINDOW), "window")
    held = wanted.withColumn("place", F.col("start") + F.col("at")).join(near, [*_PLACE, "place", "word"], "left_semi")
    whole = held.groupBy(*_PLACE, "window", "start").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return whole.where("n = size").drop("n")


def proximity_matches(index: DataFrame, benchmark: Benchmark, slop: int, rare: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """``(id_key, text_key, window, low)``: where all words of a window stand in a document nearly as in the window.

    Each posting of a word, moved back by the word's place in the window, says where the window would start; there is a match
    at ``low`` if every word of the window has such a start from ``low`` to ``low + slop``. So up to
    ``slop`` words may stand between, or words may change places within it, and with a slop
    of 0 these are the exact occurrences. ``low`` is negative where the document begins inside the window.

    The two rarest words give the starts (``rare`` and ``starts``, if they have been stored), the third rarest
    turns most of the others away, and only then all words are looked up.
    Every step is an equi-join on (document, word, block of places).
    """
    if rare is None:
        rare = checkpointed(rarest_words(index, benchmark), "benchmark-rarest")
    if starts is None:
        starts = candidate_starts(index, benchmark, rare, slop)
    first, last = F.greatest("start", "other") - slop, F.least("start", "other")
    lows = starts.select(*_PLACE, "window", "size", F.explode(F.sequence(first, last)).alias("low")).distinct()
    thirds = broadcast_if_small(rare.select("window", F.col("third").alias("word"), "third_at"), benchmark.n_windows, BROADCAST_MOST)
    lows = lows.join(thirds, "window")
    names = [*_PLACE, "window", "size", "low"]
    held = _within(lows.where("word IS NOT NULL"), _listed(index, benchmark, rare, "third"), F.col("low") + F.col("third_at"), slop)
    lows = checkpointed(held.select(names).distinct().unionByName(lows.where("word IS NULL").select(names)), "lows")

    docs = checkpointed(lows.select(*_PLACE).distinct(), "near-candidates")
    postings = index.where("word IS NOT NULL").select("word", "place", *_PLACE)
    near = postings.join(broadcast_if_small(docs, docs.count(), BROADCAST_MOST), _PLACE, "left_semi")
    words = lows.join(broadcast_if_small(benchmark.placed, benchmark.n_windows * WINDOW, BROADCAST_MOST * WINDOW), "window")
    found = _within(words, near, F.col("low") + F.col("at"), slop).select(*names, "at").distinct()
    whole = found.groupBy(*_PLACE, "window", "low").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return whole.where("n = size").select(*_PLACE, "window", "low")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slop: int | None = None) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``.

    With a ``slop`` there is ``n_near`` besides: the items with a window whose words all stand in the text within
    ``slop`` of their places (``proximity_matches``). Exact occurrences count in it; it decides nothing.

    ``n_hit`` counts the words that lie in an occurrence of a window, ``n_items`` the items
    with an occurring window, and the digest is of their ids, sorted as strings and comma-joined.
    Null and empty texts have no words and no hits. Repeated rows and rows without a doc_id
    each get their row; other columns are not read. Without items, or with items
    without words, nothing is hit.
    """
    return _by_row(docs, items, doc_id, text, item_id, item_text, slop).drop(*_PLACE)


def _by_row(docs, items, doc_id, text, item_id, item_text, slop=None):
    benchmark = read_benchmark(items, WINDOW, item_id, item_text)
    index = build_index(docs, benchmark, doc_id, text)
    rare = checkpointed(rarest_words(index, benchmark), "benchmark-rarest")
    starts = candidate_starts(index, benchmark, rare, slop or 0)
    matches = checkpointed(phrase_matches(index, benchmark, starts), "matches")
    in_order = Window.partitionBy(*_PLACE).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.groupBy(*_PLACE, "start").agg(F.max("size").alias("size")).withColumn("end", F.col("start") + F.col("size"))
    spans = spans.withColumn("done", F.coalesce(F.max("end").over(in_order), F.lit(0)))
    hits = spans.groupBy(*_PLACE).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).alias("n_hit"))
    held = matches.select(*_PLACE, "window").distinct().join(benchmark.windows, "window").select(*_PLACE, F.explode("item_ids").alias("item"))
    listed = held.groupBy(*_PLACE).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    none = F.array().cast("array<string>")
    found = hits.join(listed, _PLACE, "left")
    rows = index.where("word IS NULL").select("doc_id", *_PLACE, F.col("place").cast("long").alias("n_words")).join(found, _PLACE, "left")
    more = []
    if slop is not None:
        near = proximity_matches(index, benchmark, slop, rare, starts).select(*_PLACE, "window").distinct().join(benchmark.windows, "window")
        near = near.select(*_PLACE, F.explode("item_ids").alias("item")).groupBy(*_PLACE).agg(F.count_distinct("item").alias("n_near"))
        rows, more = rows.join(near, _PLACE, "left"), [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]
    n_hit, held = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")), F.coalesce("items", none)
    return rows.select(
        "doc_id", *_PLACE, "n_words", n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", held), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *more,
    )


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs."""
    names = [fresh(docs.columns, f"_{c}") for c in _PLACE]
    hit = _by_row(docs, items, doc_id, text, item_id, item_text).where("contaminated").select(*[F.col(c).alias(n) for c, n in zip(_PLACE, names)]).distinct()
    rows = docs.withColumns(dict(zip(names, row_keys(doc_id, text))))
    return rows.join(hit, names, "left_anti").select(*docs.columns)
