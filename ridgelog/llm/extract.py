"""Main text of web pages: flat text blocks classified by a decision tree."""

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.llm.blocktable import labelled_pages
from ridgelog.llm.common import by_runs
from ridgelog.llm.tree import DecisionTree, train

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements of the markup language and the usual names for parts of a page.
_RAW = frozenset("script style template noscript svg math iframe object textarea select option title".split())
#: raw elements whose text a browser takes as it stands up to the end tag, also behind "/>"
_VERBATIM = frozenset("script style textarea title".split())
#: an attribute without quotes, to whose value a last slash belongs
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/\Z")
#: where an option ends, whose end tag may be left out
_OPTION_END = re.compile(r"</option\b[^>]*(?:>|\Z)|(?=</?(?:optgroup|select|datalist)\b|<option\b)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements that mark the article, the surest first; names come after them
_CONTENT_TAGS = ("article", "main")
_BOILER_TAGS = frozenset("nav header footer aside form menu button dialog".split())
_CONTENT_WORDS = frozenset("article content entry main post story".split())
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "feedback footer form gdpr header login masthead menu nav navbar navigation newsletter notice notices notification pagination popup promo "
    "promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: words after which, or before which, a name tells of a wrapper what it has or lacks, not what it is
_QUALIFY_NEXT = frozenset("has have with without no not".split())
_QUALIFY_BEFORE = frozenset("enabled disabled open closed".split())
#: elements that never wrap the article
_FIRM_TAGS = _BOILER_TAGS - {"form"}
#: elements that end where a block of the same kind begins
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

#: elements that hold a block but don't set it apart from its neighbours
_LEAVES = _HEADING | frozenset("p li ul ol dl dt dd blockquote pre figure figcaption tr".split())
# How short notices and the headings of comments are worded.
_NOTICE = re.compile(
    r"copyright|©|\(c\) ?\d{4}|all rights reserved|rechte vorbehalten|droits réservés|derechos reservados|cookies?\b|privacy policy|terms (?:of|apply|and)|datenschutz|impressum|skip to|sign (?:up|in)\b|log ?in\b|subscribe|newsletter|"
    r"read (?:next|more)\b|follow us|share (?:this|on)\b|advertisement|\banzeige\b|javascript|back to top|print this|e-?mail address|your name",
    re.I,
)
_COMMENTS = re.compile(r"\W*(?:\d+ |leave a |reader |post a |add a |schreiben? sie einen? )?(?:comments?|responses?|repl(?:y|ies)|kommentare?n?|leserkommentare|commentaires?|comentarios?)\W*(?:\(?\d+\)?)?\W*", re.I)
#: a longer block is no notice, whatever words are in it
_NOTICE_WORDS = 30

#: features of a block, in this order. Words and link density of the block and of its neighbours decide; the others help:
#: home is 1 if the block stands in the element that holds most of the page's unlinked words; notice is 1 for short blocks worded
#: like one; behind is 1 from the heading of the comments on; mark is 1 in article text marked by elements and names, -1 outside of it and
#: in what is marked as something else, and 0 where a page marks nothing
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "home", "notice", "behind", "mark")
#: those that elements and names give
NAMED = (10,)


@dataclass
class Block:
    """A run of text without a block-level tag in it."""

    text: str
    words: int
    linked: int
    boilerplate: bool
    content: bool
    heading: bool
    #: the element it stands in, by number
    place: int = 0


def _words_of(name: str) -> list[str]:
    """The words of a class, id or role, without those that only qualify a wrapper (has-sidebar, no-comments, share-enabled)."""
    words = [x.lower() for x in _TOKEN.findall(name)]
    if words and words[-1] in _QUALIFY_BEFORE:
        return []
    return words[: next((k for k, w in enumerate(words) if w in _QUALIFY_NEXT), len(words))]


def _hint(tag: str, attributes: str) -> int:
    """Above 0 if an element's tag or names mark article text (3 article, 2 main, 1 a name), -1 if they mark something else, -2 if its tag does so for good, 0 if they say nothing."""
    names = set()
    if attributes and tag not in ("html", "head", "body"):
        for groups in _ATTRIBUTE.findall(attributes):
            for name in "".join(groups).split():
                names.update(_words_of(name))
    if tag in _FIRM_TAGS:
        return -2
    if tag in _BOILER_TAGS or names & _BOILER_WORDS:
        return 0 if tag == "main" or tag == "article" and not names & {"comment", "comments", "ad", "advert", "teaser", "related", "promo", "sponsored"} else -1
    return 1 + _CONTENT_TAGS[::-1].index(tag) + 1 if tag in _CONTENT_TAGS else 1 if names & _CONTENT_WORDS else 0


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space made single and character references decoded.

    Marked as content is what stands in the surest kind of mark that the page has: article elements, else main elements, else names.

    An element named like boilerplate may be a wrapper of everything. So if all marked article text lies in such elements,
    the mark is lifted from the article elements in the fewest of them; what is marked inside of these keeps it.
    """
    found: list[Block] = []
    # of each block, how many marks stand around its article element; None if the block is not to be freed of them
    wraps: list[int | None] = []
    outer: list[int] = []
    stack: list[tuple[str, int]] = []
    parts: list[tuple[str, bool]] = []
    unclosed: set[str] = set()
    # how many elements of each name are open, and where in the stack those are that are not inline
    opened: dict[str, int] = {}
    solid: list[int] = []
    places, n_places = [0], 0
    links = heading = boiler = firm = 0
    content, marks = [0, 0, 0, 0], []

    def flush():
        text = html.unescape("".join(t for t, _ in parts)).split()
        if text:
            linked = sum(len(html.unescape(t).split()) for t, inside in parts if inside)
            found.append(Block(" ".join(text), len(text), min(linked, len(text)), boiler > 0, False, heading > 0, places[-1]))
            marks.append([n > 0 for n in content])
            wraps.append(boiler if outer and outer[-1] == boiler and not firm else None)
        parts.clear()

    def leave(at):
        nonlocal links, heading, boiler, firm, content
        while len(stack) > at:
            tag, hint = stack.pop()
            opened[tag] -= 1
            if tag not in _INLINE:
                solid.pop()
                if tag not in _LEAVES:
                    places.pop()
            links -= tag == "a"
            heading -= tag in _HEADING
            boiler -= hint < 0
            firm -= hint < -1
            if hint > 0:
                content[hint] -= 1
                outer.pop()

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            parts.append((page[at:start], links > 0))
        if start == end:
            break
        m = _TAG.match(page, start)
        if not m:
            parts.append(("<", links > 0))
            at = start + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] or m[4]
        if tag in _RAW:
            attributes = m[3] or m[6] or ""
            if closing or tag not in _VERBATIM and attributes.endswith("/") and not _UNQUOTED.search(attributes):
                continue
            ending = _OPTION_END if tag == "option" else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)
            if close := None if tag in unclosed else ending.search(page, at):
                at = close.end()
                continue
            # no end tag: a script takes the rest as a browser does, of a style or title only the text goes
            unclosed.add(tag)
            if tag == "script":
                at = end
            elif tag in ("style", "title"):
                behind = page.find("<", at)
                at = behind if behind >= 0 else end
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if closing:
            if opened.get(tag):
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if solid and (tag in _SELF_CLOSING or tag in _HEADING):
            within = stack[solid[-1]][0]
            if within == tag or within == "p":
                leave(solid[-1])
        hint = _hint(tag, m[3] or m[6] or "")
        if tag not in _INLINE:
            solid.append(len(stack))
            if tag not in _LEAVES:
                n_places += 1
                places.append(n_places)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, hint))
        links += tag == "a"
        heading += tag in _HEADING
        boiler += hint < 0
        firm += hint < -1
        if hint > 0:
            content[hint] += 1
            outer.append(boiler)
    flush()
    fewest = min((n for n in wraps if n is not None), default=0)
    for block, n in zip(found, wraps):
        if n is not None and n <= fewest:
            block.boilerplate = False
    surest = max((level for b, m in zip(found, marks) if not b.boilerplate for level in range(1, 4) if m[level]), default=0)
    for block, m in zip(found, marks):
        block.content = surest > 0 and m[surest]
    return found


def features(page: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    if not page:
        return np.zeros((0, len(FEATURES)))
    outside = -1 if any(b.content for b in page) else 0
    unlinked: dict[int, int] = {}
    for b in page:
        unlinked[b.place] = unlinked.get(b.place, 0) + b.words - b.linked
    home = max(unlinked, key=unlinked.get)
    behind, rows = 0, []
    for b in page:
        behind = behind or int(b.words <= 5 and _COMMENTS.fullmatch(b.text) is not None)
        notice = b.words <= _NOTICE_WORDS and _NOTICE.search(b.text) is not None
        rows.append([b.words, b.linked / b.words, b.heading, b.place == home, notice, behind, -1 if b.boilerplate else 1 if b.content else outside])
    own, none = np.array(rows, float), np.zeros((1, 2))
    return np.hstack([own[:, :2], np.vstack([none, own[:-1, :2]]), np.vstack([own[1:, :2], none]), own[:, 2:]])


def labelled_blocks(half: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of one half of the labelled table (0: for training, 1: held out)."""
    rows, labels = [], []
    for parts in labelled_pages(half):
        whole, marks = "", []
        for markup, label in parts:
            before = len(blocks(whole))
            whole += markup
            now = len(blocks(whole)) - before
            marks += [bool(label)] * now
        found = blocks(whole)
        # an advert or comment inside a marked article carries its own mark
        rows.append(features(found))
        labels += [mark for mark, _ in zip(marks, found)]
    return np.vstack(rows), np.array(labels)


@lru_cache(maxsize=1)
def block_tree() -> DecisionTree:
    """The tree trained on the labelled table; a few kilobytes, built on the driver.

    Blocks with a mark weigh fourfold, so that what is marked beyond doubt is told apart first and the rest of the tree is learned from pages without marks.
    """
    rows, labels = labelled_blocks(0)
    weight = np.where(rows[:, NAMED[0]] != 0, 4, 1)
    return train(np.repeat(rows, weight, axis=0), np.repeat(labels, weight), depth=9, least=3)


def main_text(page: str | None, tree: DecisionTree) -> str:
    """The article text of one page; empty for null and for pages without one."""
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, tree.predict(features(found))) if keep)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null and empty pages, and pages without article text, have an empty text and 0
    characters; the whole page is read, however long; broken and unclosed markup is
    read as far as it goes: a head ends where text or an element of the body begins, a raw element
    without an end tag hides nothing behind it, save a script. Repeated rows stay; null ids and urls stay null; other columns are
    not read. Rows are independent: no shuffle, one page at a time in memory beside its batch.
    """
    tree = block_tree()

    def extract(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in by_runs(batch.column(2))]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
