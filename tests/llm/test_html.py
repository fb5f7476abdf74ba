"""Main text of pages: hand-made pages of several layouts, and the supplied layout read another way."""

import re
from html import unescape

import pytest

from tidemark.llm import html

LONG = "Some sentence here, with words. And another one; it goes on for a while, as texts do."


def body(inner, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{inner}</body></html>"


PAGES = {
    "furniture": (body(f'<nav><a href="/">Home</a></nav><header>Site</header><div class="ad">{LONG}</div><article><header><h1>Head &amp; '
                       f'line</h1><span>by x</span></header><p>One<br>two  <b>th</b>ree</p><p>{LONG}<form>sign up</form><aside>{LONG}</aside>'
                       f'<section class="comments"><p>{LONG} reader</p></section></article><footer>&copy; x</footer>'),
                  f"Head & line\nOne two three\n{LONG}"),
    "unclosed": (body("<article><h1>A</h1><p><b>First<br><p>Second &lt;i&gt; 1 < 2</p><ul><li>x<li>y</ul></article>"),
                 "A\nFirst\nSecond <i> 1 < 2\nx\ny"),
    "scripts": (body('<article><script>var t="</p><p>no";</script><p>Yes</p><!-- <p>no</p> --><style>p{}</style></article>'), "Yes"),
    "divisions": (body('<div id="top"><ul><li><a href="/a">Menu a</a></li><li><a href="/b">Menu b</a></li></ul></div><div id="page"><div id="main">'
                       + "".join(f"<p>{LONG} {i}</p>" for i in range(5)) + f'<p>Short.</p></div><div class="sidebar">{LONG}</div></div>'),
                  "\n".join([*(f"{LONG} {i}" for i in range(5)), "Short."])),
    "quoted": (body('<article><p title="a > b">x&nbsp; y</p></article>'), "x y"),
    "empty article": (body(f"<div>{LONG}</div><article> </article>"), ""),
    "null": (None, ""),
    "empty": ("", ""),
    "open comment": ("<article><p>a</p><!-- rest <p>b</p>", "a"),
    "no tags": ("just text &amp; more", "just text & more"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    source, want = PAGES[name]
    assert html.extract(source)[0] == want


def supplied(page):
    """The supplied layout: everything between the article tags, cut at block tags."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(unescape(re.sub(r"<[a-z/][^>]*>", " " if "br" in p else "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_supplied_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select("html", html.extract_udf()("html")["text"].alias("text")).collect()
    assert rows and all(r.text == supplied(r.html) for r in rows)


def test_long_pages_and_repeats(spark):
    page = body("<article>" + "<p>word.</p>" * 20_000 + "</article>")
    docs = spark.createDataFrame([(1, page), (1, page), (None, None)], "page_id long, html string")
    got = [r.m.blocks for r in docs.select(html.extract_udf()("html").alias("m")).collect()]
    assert sorted(got) == [0, 20_000, 20_000]
