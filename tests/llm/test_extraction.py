"""Extraction: planted page parts, broken markup, the driver's pages against a direct reading of their template."""
import re
from html import unescape

import pytest

from riskweave.llm import extraction
from riskweave.llm.queries import op4_extraction

LONG = "A sentence with several words, commas, and a stop. Then another one; it goes on, and on."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><div>Site name</div><nav><a href=/>Home</a></nav></header><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies, please agree.</div><aside>Latest: this, that.</aside>
<article><header><h1>Head &amp; line</h1><span>by someone</span></header><p>{LONG} <a href=x>link</a></p><div class="ad-box"><p>Buy, buy, buy.</p></div>
<p>Short.</p><ul><li>one<li>two &#233; &eacute;</ul><table><tr><td>a<td>b<tr><td>c</table><blockquote>Quoted   text.</blockquote>
<form><input name=q><p>Subscribe, now.</p></form><figure><img src=x><figcaption>Caption here</figcaption></figure></article>
<section id="comments"><article><p>First! {LONG}</p></article></section><footer>&copy; 2020, all rights.</footer></body></html>"""


def test_parts():
    assert extraction.main_text(PAGE).split("\n\n") == [
        "Head & line", LONG + " link", "Short.", "one", "two é é", "a", "b", "c", "Quoted text.", "Caption here"]


def test_page_without_article():
    page = f"""<body><div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div><a href=3>Three</a> | <a href=4>Four</a></div>
    <div id=content><h2>Title</h2><p>{LONG}<p>{LONG}<p>Short one.</div><div id=sidebar><p>{LONG}</p></div><div>Imprint</div></body>"""
    assert extraction.main_text(page).split("\n\n") == ["Title", LONG, LONG, "Short one."]


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<p>a<br>b</p>", "a b"), ("<p>x < y & z &lt; &unknown; &am</p>", "x < y & z < &unknown; &am"),
    ("<article><p><b>one<br><p>two</p></article><p>out</p>", "one\n\ntwo"), ("<div>a</b></p>b</div>", "a\n\nb"), ("<p>a<!-- open <p>b", "a"),
    ("<p>a<script>x", "a"), ("<p title='a>b\"'>q</p>", "q"), ("<p>a&nbsp;&nbsp;b\n\tc</p>", "a b c"), ("<nav>only a menu</nav>", ""), ('<p hidden>no</p><p class="x">yes', "yes"),
    ("<p title='>never closed", "never closed"), ("a" * 200_000, "a" * 200_000), ("<p>w</p>" * 2000, "\n\n".join(["w"] * 2000)),
])
def test_small_pages(html, text):
    assert extraction.main_text(html) == text


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGE, "clash", "x"), (1, "u", PAGE, None, None), (None, None, None, None, None), (2, "v", "", "", "")]
    got = extraction.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 4
    assert all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract(spark.createDataFrame([], schema)).collect() == []


def test_query_against_template(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = op4_extraction(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?(?:b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x)


PARAGRAPH = "<p>" + "This is a long paragraph of the article, with commas, and more. " * 6 + "</p>"
PLAIN = " ".join(("This is a long paragraph of the article, with commas, and more. " * 6).split())


@pytest.mark.parametrize("name", ["elementor-widget-container", "content no-sidebar", "post has-comments", "social-studies", "notice of public hearing", "search-results-page main",
                                  "tags-and-history", "header-fixed layout", "comments", "sidebar"])
def test_a_class_word_alone_does_not_take_the_article(name):
    page = f"<html><body><nav><a href='/'>Home</a></nav><div class='{name}'>{PARAGRAPH}{PARAGRAPH}<div class='ad'><p>Buy this now, it is cheap.</p></div></div><footer>Imprint</footer></body></html>"
    assert extraction.main_text(page) == PLAIN + "\n\n" + PLAIN


def test_named_parts_beside_an_article_go():
    comment = "<div class='comment'><p>I do not agree with this at all, as I said before, and will say again.</p></div>"
    page = f"<body><div class='post'>{PARAGRAPH}{PARAGRAPH}</div><section id='comments'>{comment * 6}</section><div class='cookie-notice'><p>We use cookies, as all do, to keep you signed in.</p></div></body>"
    assert extraction.main_text(page) == PLAIN + "\n\n" + PLAIN
    inside = f"<article><div class='post-header'><h1>A title of the article</h1><p>By somebody, on Monday</p></div>{PARAGRAPH}{PARAGRAPH}<section class='comments'><h3>Comments</h3>{comment * 3}</section></article>"
    assert extraction.main_text(inside) == "A title of the article\n\n" + PLAIN + "\n\n" + PLAIN


def test_ratios_decide_where_nothing_is_declared():
    """No tags or classes that say anything: lists of links and short lines go, paragraphs stay."""
    menu = "<div>" + "".join(f"<div><a href='/{k}'>Section {k}</a></div>" for k in range(8)) + "</div>"
    related = "<div><div><a href='/x'>Read also this other story of ours</a></div><div><a href='/y'>And that one</a></div></div>"
    page = f"<html><body>{menu}<div><div>{PARAGRAPH}{PARAGRAPH}</div></div>{related}<div><span>Terms</span></div></body></html>"
    found, above = extraction.blocks(page)
    assert len(found) > 11 and extraction.select(found, above) == [PLAIN, PLAIN]


@pytest.mark.parametrize("page", ["<div>some words, here " * 20_000, "<div>" * 30_000 + "<li>x</li>" * 30_000 + "<b>" * 30_000 + "</i>" * 30_000,
                                  "<div class='ad'>words here, " * 20_000, "<table><tr><td>" * 15_000 + "x" + "</p>" * 15_000])
def test_time_is_linear_in_deep_pages(page):
    import time
    start = time.process_time()
    extraction.main_text(page)
    whole = time.process_time() - start
    start = time.process_time()
    extraction.main_text(page[:len(page) // 4])
    quarter = time.process_time() - start
    assert whole < 8 and whole < 9 * quarter + 0.5
