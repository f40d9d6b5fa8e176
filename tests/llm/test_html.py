"""Main text of pages: the markup, the differencing and its alignment."""

from __future__ import annotations

import random
import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import SMALL
from waymark.llm import html
from waymark.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, text string, host string"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25), st.sampled_from([6, 2**24]))
def test_alignment_is_a_longest_common_subsequence(a, b, cells):
    before, html.CELLS = html.CELLS, cells
    places = html.common_lines(a, b)
    html.CELLS = before
    rest = iter(b)
    assert len(places) == lcs(a, b) and places == sorted(set(places)) and all(any(y == a[i] for y in rest) for i in places)


def kept(source):
    page = html.Page(source)
    return [x for x, s in zip(page.lines, page.scopes) if s != html.MARKED]


@pytest.mark.parametrize(
    "source, lines",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<article><h1>A &amp; B</h1><p>x <b>y</b>z<p>w<br>v</article><footer>f</footer>", ["A & B", "x yz", "w", "v"]),
        ("<nav>n</nav><main><h1>M</h1>t</main><div>o</div>", ["M", "t"]),
        ("<header>h</header><div>a</div><aside>s</aside><form>f<button>b</button></form>", ["a"]),
        ("<article><header><h1>T</h1></header>x<footer>by</footer></article>", ["T", "x"]),
        ("<body class=has-sidebar><form id=search-page><article>x</article></form>", ["x"]),
        ("<article>x<div class='comments'><article class='comment'>c</article></div></article>", ["x"]),
        ("<div role=navigation>n</div><div hidden>h</div><p title='a hidden sidebar>'>p</p>", ["p"]),
        ("<div class='cookie-notice'>c</div><div class='site-ad'>a</div><div class='shade'>s</div>", ["s"]),
        ("<script>if (a</b>c) '<p>no</p>'</script>x<style>p{}</style><!-- <p>no</p> -->y", ["xy"]),
        ("<title>t</title>x<textarea>no<p></textarea>", ["x"]),
        ("a < b, c <= d &lt;p&gt; &nbsp; e", ["a < b, c <= d <p> e"]),
        ("x<!-- never closed", ["x"]),
        ("x<script>never closed", ["x"]),
        ("x<p", ["x"]),
        ('<p "odd>one</p><p>two</p>', ["one", "two"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("</p></div>x</b>", ["x"]),
        ("İ<SCRIPT>no</SCRIPT>x", ["İx"]),
    ],
)
def test_markup(source, lines):
    assert kept(source) == lines


def test_query_gives_the_articles(spark):
    got = {r["page_id"]: r for r in QUERIES["op13_html_text"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        body = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        text = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", "\n", body))).split())
        assert got[page["page_id"]]["text"] == text and got[page["page_id"]]["n_chars"] == len(text)


def site(rng, host, n, plain):
    """Pages of a host, with what the article is: template lines around it, without any markup if plain."""
    words = [f"{host}w{k}" for k in range(400)]
    sentence = lambda size: " ".join(rng.choices(words, k=size))
    top, bottom, middle = ([sentence(rng.randint(1, 6)) for _ in range(5)] for _ in range(3))
    for k in range(n):
        own = [sentence(rng.randint(5, 60)) for _ in range(rng.randint(3, 12))]
        lines = top + own[:2] + middle[:1] + own[2:] + bottom
        yield f"http://{host}/a/{k:04}", "".join(f"<div>{x}</div>" for x in lines) if plain else f"<article><p>{'<p>'.join(own)}</article>", " ".join(own)


def test_differencing_finds_templates_without_markup(spark):
    rng = random.Random(5)
    rows, wanted = [], {}
    for host, n in (("one.example", 300), ("two.example", 3), ("three.example", 70)):
        for url, source, text in site(rng, host, n, plain=True):
            wanted[len(rows)] = text
            rows.append((len(rows), url, source, "clash", "clash"))
    # Copies of one article at neighbouring URLs are no template.
    url, source, text = next(iter(site(rng, "one.example", 1, plain=True)))
    copy = re.sub("<div>", "<div>", source)
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == wanted
    assert all(r["n_shared"] == 11 and r["n_marked"] == 0 for r in got.values())


def test_copies_keep_their_article_and_articles_their_shared_passages(spark):
    rng = random.Random(6)
    pages = list(site(rng, "one.example", 40, plain=True))
    url, source, text = pages[20]
    pages += [(f"{url}?page={k}", source, text) for k in range(30)]
    passage = "<p>a passage that all articles of this host hold</p>"
    marked = [(f"http://other.example/{k}", f"<nav>menu</nav><article><p>own {k} words of this page</p>{passage}</article>", f"own {k} words of this page a passage that all articles of this host hold") for k in range(10)]
    pages += marked
    df = spark.createDataFrame([(k, u, s, "x", "y") for k, (u, s, _) in enumerate(pages)], PAGES)
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got == {k: t for k, (_, _, t) in enumerate(pages)}


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None, None, "", ""), (1, None, None, "", ""), (None, "no host", "<p>a", "", ""), (2, "http://h", "", "", ""), (3, "http://h/x", "<p>" * 20_000 + "<p>".join(f"line {k}" for k in range(50_000)), "", "")]
    df = spark.createDataFrame(rows, PAGES)
    got = [tuple(r)[:4] for r in html.main_text(df).collect()]
    assert len(got) == 5 and got.count((1, None, "", 0)) == 2 and (None, "no host", "a", 1) in got and (2, "http://h", "", 0) in got
    assert html.main_text(df.where("false")).count() == 0
