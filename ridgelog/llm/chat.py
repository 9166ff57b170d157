"""Quotation linking: replies joined to the messages whose passages they quote."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgelog.functions.positions import numbered
from ridgelog.session import checkpointed

_MARK = r"^[ \t]*((?:>[ \t]?)+)"
#: a line of a message's own that begins like a quote is written with one backslash more
_ESCAPED = r"^([ \t]*)\\(\\*>)"
#: where a line begins: at the start, behind a line feed, or behind a carriage return that no line feed follows
_BEGIN = r"(?:\A|(?<=\n)|(?<=\r)(?!\n))"


def _when(test: Column, changed: Column, text: Column) -> Column:
    """``changed`` where the cheap test says that it may differ from ``text``; regular expressions over whole mails are the costly part of this operator."""
    return F.when(test, changed).otherwise(text)


def _lines(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.split(_when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n"), text), "\n")


def _begins(line: Column, mark: str) -> Column:
    """Whether a line begins so, blanks aside."""
    return F.ltrim(line, F.lit(" \t")).startswith(mark)


def _level(line: Column) -> Column:
    """The number of quote marks in front of a line."""
    marks = F.regexp_extract(line, _MARK, 1)
    return F.when(_begins(line, ">"), F.length(F.regexp_replace(marks, "[^>]", ""))).otherwise(0)


def _body(line: Column) -> Column:
    unescaped = lambda x: _when(_begins(x, "\\"), F.regexp_replace(x, _ESCAPED, "$1$2"), x)
    return F.when(_begins(line, ">"), unescaped(F.regexp_replace(line, _MARK, ""))).otherwise(unescaped(line))


def own_text(text: Column) -> Column:
    """The text without its quoted lines, all other characters as they stand, trimmed; a backslash before a line's first ``>`` is taken off."""
    text = F.coalesce(text, F.lit(""))
    by_lines = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~_begins(x, ">")), "\n")
    own = F.regexp_replace(text, _BEGIN + r"[ \t]*>[^\r\n]*(?:\r\n|\r|\n|\z)", "")
    own = F.when(~text.contains(">"), text).when(text.contains("\r"), own).otherwise(by_lines)
    return F.trim(_when(text.contains("\\"), F.regexp_replace(own, _BEGIN + _ESCAPED[1:], "$1$2"), own), F.lit(" \t\r\n"))


def normalised(text: Column) -> Column:
    """Lower case, and white space of any length as one space, none at the ends."""
    lower = F.lower(text)
    uneven = text.contains("  ")
    for mark in "\t\n\r\f\v":
        uneven = uneven | text.contains(mark)
    return F.trim(_when(uneven, F.regexp_replace(lower, r"\s+", " "), lower))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, levels, own)``: the quote level of every line with a word in it, and the text without quotes.

    ``levels`` has ``(level, line)`` with the quote marks taken off the line.
    """
    lines = _lines(F.col("text"))
    split = F.transform(lines, lambda x: F.struct(_level(x).alias("level"), _body(x).alias("line")))
    return messages.select(*messages.columns, own_text(F.col("text")).alias("own"), F.filter(split, lambda x: F.trim(x["line"], F.lit(" \t\f\v")) != "").alias("levels"))


def _passage(lines: Column) -> Column:
    """The hash of normalised lines one after the other."""
    return F.unhex(F.sha2(F.array_join(F.transform(lines, lambda x: normalised(x["line"])), "\n"), 256))


def run_hashes(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, passage, n)``: the hash of every run of quoted lines of one level, and of all a message's own lines (level 0)."""
    at = F.sequence(F.lit(0), F.size("levels") - 1)
    begins = F.when(F.size("levels") > 0, F.filter(at, lambda i: (i == 0) | (F.col("levels")[i]["level"] != F.try_element_at("levels", F.greatest(i, F.lit(1)))["level"])))
    # one element, so that the optimizer computes the levels and where they begin only once
    rows = parsed.select("conv_id", "turn", F.explode(F.array(F.col("levels"))).alias("levels")).where("size(levels) > 0")
    rows = rows.select("conv_id", "turn", "levels", F.explode(F.array(begins)).alias("begins"))

    def run(begin, k):
        end = F.coalesce(F.try_element_at("begins", k + 2), F.size("levels"))
        return F.struct(F.col("levels")[begin]["level"].alias("level"), F.slice("levels", begin + 1, end - begin).alias("lines"))

    own = F.filter("levels", lambda x: x["level"] == 0)
    runs = F.concat(
        F.filter(F.transform("begins", run), lambda r: r["level"] > 0),
        F.filter(F.array(F.struct(F.lit(0).alias("level"), own.alias("lines"))), lambda r: F.size(r["lines"]) > 0),
    )
    runs = rows.select("conv_id", "turn", F.explode(runs).alias("r"))
    return runs.select("conv_id", "turn", F.col("r.level").alias("level"), _passage(F.col("r.lines")).alias("passage"), F.size("r.lines").cast("long").alias("n"))


def line_hashes(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, passage)``: the hash of every line with a word, normalised; level 0 is the message's own."""
    lines = parsed.select("conv_id", "turn", F.explode("levels").alias("q"))
    return lines.select("conv_id", "turn", F.col("q.level").alias("level"), F.unhex(F.sha2(normalised(F.col("q.line")), 256)).alias("passage"))


def linked_passages(passages: DataFrame, block: int = 1024) -> DataFrame:
    """``(conv_id, turn, level, passage, n, quoted_turn)``: the quotes of ``passages`` with the earlier message that holds them, null if none does.

    A quoted passage (level above 0) is joined to the earlier messages of its conversation that hold it as
    their own, by the hash; of several the latest is meant. Quotes and originals meet by
    (conversation, passage, block of turns); where a passage returns all through a long
    conversation, each block also takes over the latest original of the blocks before, so
    neither pairs of messages nor whole conversations ever meet in a task.
    """
    quotes = passages.where("level > 0").groupBy("conv_id", "turn", "level", "passage").agg(F.sum("n").alias("n"))
    source = passages.where("level = 0").select("conv_id", "turn", "passage").distinct().withColumn("held", F.col("turn"))
    met = quotes.unionByName(source, allowMissingColumns=True).withColumn("block", F.floor(F.col("turn") / block))
    before = Window.partitionBy("conv_id", "passage", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("near", F.max("held").over(before)).where("level IS NOT NULL").drop("held")
    first, last = passages.agg(F.min(F.floor(F.col("turn") / block)), F.max(F.floor(F.col("turn") / block))).first()
    if first == last:  # all turns lie in one block
        return met.withColumnRenamed("near", "quoted_turn").drop("block")
    lasts = source.groupBy("conv_id", "passage", F.floor(F.col("turn") / block).alias("block")).agg(F.max("held").alias("last"))
    asked = met.where("near IS NULL").select("conv_id", "passage", "block").distinct()
    blocks = lasts.unionByName(asked.withColumn("last", F.lit(None).cast("long"))).groupBy("conv_id", "passage", "block").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("conv_id", "passage").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("far", F.max("last").over(earlier)).where("far IS NOT NULL").drop("last")
    linked = met.join(blocks, ["conv_id", "passage", "block"], "left")
    return linked.withColumn("quoted_turn", F.coalesce("near", "far")).drop("near", "far", "block")


def link_quotes(lines: DataFrame, block: int = 1024) -> DataFrame:
    """``(conv_id, turn, quoted_turn, level, n_lines)`` from the hashes of single lines: which earlier messages a message quotes, at which level, in how many lines."""
    linked = linked_passages(lines.withColumn("n", F.lit(1).cast("long")), block).where("quoted_turn IS NOT NULL")
    return linked.groupBy("conv_id", "turn", "quoted_turn", "level").agg(F.sum("n").alias("n_lines"))


def quote_links(parsed: DataFrame, block: int = 1024) -> DataFrame:
    """The links of ``link_quotes``, by whole passages first and line by line where no earlier message is a run of quoted lines as a whole.

    So a common line ("yes", "thanks") that stands in a longer quote links nothing by itself, if the quote is known.
    """
    runs = checkpointed(run_hashes(parsed), "quote-runs")
    linked = checkpointed(linked_passages(runs, block), "quote-links")
    known = linked.where("quoted_turn IS NOT NULL")
    links = known.groupBy("conv_id", "turn", "quoted_turn", "level").agg(F.sum("n").alias("n_lines"))
    unknown = linked.where("quoted_turn IS NULL")
    if unknown.isEmpty():
        return links
    # lines of conversations in which a run is unknown; lines of runs that are known are taken off again
    lines = line_hashes(parsed.join(unknown.select("conv_id").distinct(), "conv_id", "left_semi"))
    open_ = unknown.select("conv_id", "turn", "level").distinct()
    own, quoted = lines.where("level = 0"), lines.where("level > 0").join(open_, ["conv_id", "turn", "level"], "left_semi")
    single = link_quotes(checkpointed(own.unionByName(quoted), "quote-lines"), block).join(known.select("conv_id", "turn", "level").distinct(), ["conv_id", "turn", "level"], "left_anti")
    return links.unionByName(single.select(links.columns))


def reply_links(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to, n_linked)``: the message that most lines of the shallowest linked level come from, of equals the latest; and how many lines are linked."""
    by = F.struct(-F.col("level"), "n_lines", "quoted_turn")
    return links.groupBy("conv_id", "turn").agg(F.max(by)["quoted_turn"].alias("reply_to"), F.sum("n_lines").alias("n_linked"))


def threads(replies: DataFrame) -> DataFrame:
    """``(conv_id, turn, root, depth)`` of every message by doubling the way to the root in each round; further columns stay.

    ``replies`` has ``(conv_id, turn, reply_to)``, null for a message that quotes nothing known.
    Replies point to earlier turns, so there are no circles, and the rounds are
    the logarithm of the longest chain. Every round is one join on (conversation,
    turn) and is written to the shared folder; messages that have found their root
    take no further part in it but as targets.
    """
    at_root = F.col("reply_to").isNull()
    more = [c for c in replies.columns if c not in ("conv_id", "turn")]
    ways = replies.select("conv_id", "turn", *more, F.coalesce("reply_to", "turn").alias("root"), F.when(at_root, 0).otherwise(1).alias("depth"), at_root.alias("final"))
    ways = checkpointed(ways, "threads")
    found, open_ = ways.where("final"), ways.where("NOT final")
    while not open_.isEmpty():
        targets = found.union(open_).select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("final").alias("there"))
        step = open_.drop("final").join(targets, ["conv_id", "root"]).select(
            "conv_id", "turn", *more, F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("final")
        )
        step = checkpointed(step, "threads")
        found, open_ = found.union(step.where("final")), step.where("NOT final")
    return found.drop("final")


def positions(placed: DataFrame) -> DataFrame:
    """``placed`` with the ``position`` of every (conversation, turn) in its thread, from 0 by turn, without a task that sees a whole conversation."""
    ranked = numbered(placed, ["conv_id", "root", "turn"], "_rank")
    first = ranked.groupBy("conv_id", "root").agg(F.min("_rank").alias("_first"))
    return ranked.join(first, ["conv_id", "root"]).withColumn("position", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def format_conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, own, reply_to, root, depth, n_quoted, n_linked, position)`` for every message.

    ``own`` is the text without quoted lines and trimmed, all else as it stands; lines end at a line feed, a carriage return, or both. A line
    whose first mark is escaped by a backslash is the message's own, and the backslash goes. ``reply_to`` is the turn it answers,
    ``root`` and ``depth`` its place in the thread and ``position`` its number there; ordering by (conv_id, root, position) gives the
    conversations in reply order. ``n_quoted`` counts the quoted lines with a word
    and ``n_linked`` those that an earlier message holds. Messages without quotes,
    null and empty texts included, are roots of depth 0 (their own text is empty if null). Messages
    without a conversation or turn cannot be linked, are roots of themselves and have position 0. Rows that
    repeat a (conversation, turn) each stay and share the place and the links of all of them. Turns may have gaps. An empty table
    gives no rows. Other columns are not read.
    """
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).cast("string").alias("text"))
    parsed = quoted_lines(rows).drop("text")
    linkable = "conv_id IS NOT NULL AND turn IS NOT NULL"
    replies = rows.where(linkable).select("conv_id", "turn").distinct().join(reply_links(quote_links(parsed.where(linkable))), ["conv_id", "turn"], "left")
    placed = positions(threads(replies))
    n_quoted = F.size(F.filter("levels", lambda x: x["level"] > 0)).cast("long")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return parsed.select("conv_id", "turn", "role", "own", n_quoted.alias("n_quoted")).join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "own", "reply_to", F.coalesce("root", "turn").alias("root"), none("depth"), "n_quoted", none("n_linked"), none("position")
    )


def as_mails(messages: DataFrame) -> DataFrame:
    """Conversations written as mails: every message quotes the one before it, with that one's quote of the message before.

    ``messages`` has ``(conv_id, turn, role, text)``; the message before is that of the turn less 1, and a gap quotes nothing. Of rows that repeat a
    (conversation, turn) the one with the smallest text is quoted, and every row becomes one mail. Quote marks stand before every line as the
    parser takes them, and a line that begins like a quote or an escaped one gets a backslash. Null texts are not quoted.
    """
    text = F.col("text")
    escaped = _when(text.contains(">"), F.regexp_replace(text, _BEGIN + r"([ \t]*)(\\*>)", r"$1\\$2"), text)
    by_lines = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))
    quote = lambda text, mark: _when(text.contains("\r"), F.regexp_replace(text, _BEGIN, mark), by_lines(text, mark))
    rows = messages.select("conv_id", "turn", "role", escaped.alias("text"))
    texts = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    earlier = lambda by, name: texts.select("conv_id", (F.col("turn") + by).alias("turn"), F.col("text").alias(name))
    rows = rows.join(earlier(1, "_one"), ["conv_id", "turn"], "left").join(earlier(2, "_two"), ["conv_id", "turn"], "left")
    mail = F.concat_ws("\n", quote(F.col("_two"), ">> "), quote(F.col("_one"), "> "), "text")
    return rows.select("conv_id", "turn", "role", mail.alias("text"))
