"""URL rules and main-text extraction."""

import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from ridgelog.llm.extract import FEATURES, NAMED, block_tree, blocks, extract_main_text, labelled_blocks, main_text
from ridgelog.llm.tree import train
from ridgelog.llm.urlrules import Rule, judge_urls, rules_table

RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("b.net", "", "block")]


def judged(url, rules=RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if host and ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def random_url(rng):
    labels = [rng.choice(["www", "example", "EXAMPLE", "com", "net", "b", "é", ""]) for _ in range(rng.randrange(0, 5))]
    parts = [rng.choice(["en", "es", "fr", "x", ""]) for _ in range(rng.randrange(0, 4))]
    return rng.choice(["http://", "://", "", "a://b://"]) + ".".join(labels) + "".join("/" + p for p in parts) + rng.choice(["", "/", "?q=/en/", "#x", "?a#b"])


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(3)
    urls = [None, "", "http://", "http://com", "http://com/", "x", "http://a.com/\n/en/"] + [random_url(rng) for _ in range(600)]
    urls += urls[:50]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rules_table(spark, RULES)).collect()}
    assert found == {i: judged(u) for i, u in enumerate(urls)}


def test_url_rules_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, rules_table(spark, []), default="block").collect()] == [(1, "a.com", "/x", None, "block")]
    assert judge_urls(pages.where("false"), rules_table(spark, RULES)).count() == 0
    twice = rules_table(spark, [Rule("a.com", "/x", "block"), Rule("A.com", "/x", "allow"), Rule("", "/", "block")])
    assert judge_urls(pages, twice).first()["verdict"] == "allow"


def test_rule_hosts_are_lower_cased_like_urls(spark):
    """A-Z only, on both sides."""
    pages = spark.createDataFrame([(1, "http://www.É.com/x"), (2, "http://é.com/x"), (3, "http://ABC.com/")], "page_id long, url string")
    rules = [Rule("É.COM", "/", "block"), Rule("aBc.com", "/", "block")]
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, rules_table(spark, rules)).collect()}
    assert found == {1: ("É.com/", "block"), 2: (None, "allow"), 3: ("abc.com/", "block")}


def test_url_rules_stay_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    plan = judge_urls(pages, rules_table(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>text.<br>After\n  break</p><p>x</p></article>"
AROUND = {
    "nav": "<nav><ul><li><a href='/'>Home</a></li></ul></nav>",
    "header": "<header><h2>Site name</h2></header>",
    "aside": "<aside>Something long that is not the article, in many words, and yet more of them.</aside>",
    "notice": "<div class='cookie-notice'><p>We use cookies on this page, for reasons that take a long sentence.</p></div>",
    "ad": "<div class=ad>Buy it now, it is cheap and good and everything else that one could say.</div>",
    "form": "<form><label>Name</label><input name=a><button>Send</button></form>",
    "script": "<script>var t = '</p>';</script><style>p{margin:0}</style>",
    "comments": "<section id=comments><article class=comment><p>A reader has much to say about this article.</p></article></section>",
    "footer": "<footer>&copy; example</footer>",
}


@pytest.mark.parametrize("name", AROUND)
@pytest.mark.parametrize("hold", ["article", "main", "div class='post-content'"])
def test_parts_of_a_page_are_left_out(name, hold):
    page = ARTICLE.replace("<article>", f"<{hold}>").replace("</article>", f"</{hold.split()[0]}>")
    assert main_text(f"<html><body>{AROUND[name]}{page}{AROUND[name]}</body></html>", block_tree()) == "Title & more First boldtext. After break x"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<p", ""), ("no markup, a < b &lt; c", "no markup, a < b < c"), ("<article><p>cut &am", "cut &am"),
        ("<article><p>one<p>two<!-- x -->!</article", "one two!"), ("<article>" + "<p>w</p>" * 5000 + "</article>", " ".join(["w"] * 5000)),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page, block_tree()) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><meta charset=u><title>T</title><body><article><p>one two</p></article>", "one two"),
        ("<head><title>T</title><link rel=x><article><p>one two</p></article>", "one two"),
        ("<article><p>one <svg class='i' viewBox='0 0 1 1'/> two</p><p>three <svg><text>no</text></svg></p></article>", "one two three"),
        ("<article><p>one <svg xmlns=http://x/svg/><text>no</text></svg> two</p></article>", "one two"),
        *[(f"<article><p>one</p><{t} id='x'/><p>two</p></article>", "one two") for t in ("math", "iframe", "object", "template")],
        *[(f"<article><p>one</p><{t}><p>two</p></article>", "one two") for t in ("svg", "math", "iframe", "object", "noscript", "select")],
        ("<article><p>one</p><style>p{margin:0}<p>two</p></article>", "one two"),
        ("<article><datalist><option>a<option>b</datalist><p>one</p></article><form><select><option>c</option></select></form>", "one"),
        ("<article><p>one</p><script>var t = '<p>two</p>';", "one"),
        ("<article><p>one</p>" + "<svg>" * 50000 + "<p>two</p></article>", "one two"),
    ],
)
def test_raw_elements_without_end(page, text):
    assert main_text(page, block_tree()) == text


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='page with-header'", "div class='post no-comments'", "div class='share-enabled'", "div class=withSidebar",
                                     "div class='sidebar-layout'", "section id=search", "form action='/'", "div class='layout-comments'"])
@pytest.mark.parametrize("hold", ["article", "main", "div class='post-content'"])
def test_a_wrapper_named_like_boilerplate_keeps_its_article(wrapper, hold):
    inside = "<div class='ad'>Buy it now, it is cheap and good and everything else.</div></article>"
    page = ARTICLE.replace("</article>", inside).replace("<article>", f"<{hold}>").replace("</article>", f"</{hold.split()[0]}>")
    around = AROUND["nav"] + AROUND["notice"] + "<div class=related><article><p>Another page has many more words on it.</p></article></div>"
    whole = f"<body><{wrapper}>{page}{around}{AROUND['comments']}</{wrapper.split()[0]}>{AROUND['footer']}</body>"
    assert main_text(whole, block_tree()) == "Title & more First boldtext. After break x"


def test_a_name_without_qualifier_still_marks():
    page = ARTICLE + "<div class='sidebar'><div class='post'>Another page has many more words on it.</div></div><aside><article>So has this one, and more.</article></aside>"
    assert main_text(page, block_tree()) == "Title & more First boldtext. After break x"


def test_extraction_equals_the_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = extract_main_text(pages).collect()
    marked = {r["page_id"]: re.search("(?s)<article>(.*)</article>", r["html"])[1] for r in pages.collect()}
    for r in rows:
        plain = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?p>|</?h1>|<br>", " ", marked[r["page_id"]])))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])
    assert len(rows) == pages.count()


PARAGRAPH = "<p>The old bridge across the river was opened again on Monday after three years of work. Hundreds of people came to see it.</p>"
STORY = "<h1>The bridge is open</h1>" + PARAGRAPH + "<p>He agreed.</p>" + PARAGRAPH
TOLD = html.unescape(" ".join(re.sub("<[^>]*>", " ", STORY).split()))
LINKS = "<li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li>"


@pytest.mark.parametrize("before", ["", "<p>Site name</p>", "<div>Skip to content</div>", "<h2>Site</h2><p>Since 1921</p>"])
@pytest.mark.parametrize("behind", ["", "<div>Sign up today</div><p>Read next</p>", "<p>Terms apply</p>", "<p>x</p><p>One more notice of seven words here.</p>"])
@pytest.mark.parametrize("hold", ["article", "main", "div class='post-content'"])
def test_notices_outside_the_article_are_left_out(hold, before, behind):
    page = f"<body><div class='content wrapper'>{before}<{hold}>{STORY}</{hold.split()[0]}>{behind}</div>{before}</body>"
    if hold[:3] == "div":  # names alone don't tell the wrapper from the post
        page = page.replace("content wrapper", "wrapper")
    assert main_text(page, block_tree()) == TOLD


@pytest.mark.parametrize(
    "before, behind",
    [
        (f"<ul>{LINKS}</ul>", "<div>Copyright 2024 ACME all rights reserved</div>"),
        ("<div>We use cookies to improve your visit here</div><div><a href=1>Home</a> <a href=2>News</a></div>", ""),
        ("<div>Skip to content please now</div>", "<h3>Comments</h3><div><p>Great article, I liked every word of it!</p></div><div><p>Not true at all.</p></div>"),
        (f"<div class='menue'>{LINKS}</div><div class='inhalt'>", "</div><div class='kommentare'><h3>Kommentare</h3><p>Toller Beitrag, vielen Dank!</p></div><div class='impressum'>Impressum und Datenschutz</div>"),
        (f"<table><tr><td><ul>{LINKS}</ul></td><td>", "</td><td><p>Our author lives by the river.</p></td></tr></table>"),
    ],
)
def test_pages_that_mark_nothing(before, behind):
    assert main_text(f"<body>{before}{STORY}{behind}</body>", block_tree()) == TOLD


def test_counts_and_densities_decide_held_out_blocks():
    """The other half of the labelled texts: with all features, and without those that names and elements give."""
    (rows, labels), (held, truth) = labelled_blocks(0), labelled_blocks(1)
    assert len(held) > 800 and (block_tree().predict(held) == truth).mean() > 0.96
    plain = [k for k in range(len(FEATURES)) if k not in NAMED]
    assert (train(rows[:, plain], labels, depth=8, least=3).predict(held[:, plain]) == truth).mean() > 0.92
    nameless = (held[:, list(NAMED)] == 0).all(axis=1)
    assert nameless.mean() > 0.3 and (block_tree().predict(held[nameless]) == truth[nameless]).mean() > 0.94
    # the six that are given by counting alone do much better than taking every block, or none
    assert (train(rows[:, :6], labels, depth=8, least=3).predict(held[:, :6]) == truth).mean() > 0.75


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<i>" * (n // 7) + "</b>" * (n // 7), lambda n: "a<" + "b" * n, lambda n: "<i>" * (n // 6) + "<p>" * (n // 6), lambda n: "<div>" * (n // 10) + "x</p>" * (n // 10),
        lambda n: "<a '" * (n // 4), lambda n: "<svg>" * (n // 5), lambda n: "<!--" * (n // 4), lambda n: "<li>x" * (n // 5), lambda n: "<p class=" + "'x " * (n // 3),
    ],
)
def test_time_grows_with_the_page(page):
    spent = []
    for n in (1 << 16, 1 << 18):
        begun = time.process_time()
        main_text(page(n), block_tree())
        spent.append(time.process_time() - begun)
    assert spent[1] < max(10 * spent[0], 0.5)


class Plain(HTMLParser):
    """The blocks of well-formed markup by the standard parser: (text, words inside links)."""

    SOLID = set("html body div p ul li h1 h2 h3 nav header footer aside article main table tr td section br".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.parts, self.links, self.raw = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style", "title")
        if tag in self.SOLID:
            self.flush()
        self.links += tag == "a"

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style", "title")
        if tag in self.SOLID:
            self.flush()
        self.links -= tag == "a"

    def handle_data(self, data):
        if not self.raw:
            self.parts.append((data, self.links > 0))

    def flush(self):
        words = "".join(d for d, _ in self.parts).split()
        if words:
            self.found.append((" ".join(words), sum(len(d.split()) for d, inside in self.parts if inside)))
        self.parts = []


def test_blocks_equal_those_of_another_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    pages += [f"<body><div>{AROUND[a]}</div>{ARTICLE}<div>{AROUND[b]}</div></body>" for a in AROUND for b in AROUND if "form" not in (a, b)]
    for page in pages:
        other = Plain()
        other.feed(page)
        other.flush()
        assert [(b.text, b.linked) for b in blocks(page)] == other.found


def test_extraction_keeps_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", ARTICLE, 2), (1, "u", ARTICLE, 2)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in extract_main_text(pages).collect()) == [(0, 0), (1, 42), (1, 42)]
    assert extract_main_text(pages.where("false")).count() == 0
