"""Operator 12: pages with a known article, and minimum cuts by enumeration."""

import html
import itertools
import random
import re

import pytest
from conftest import SF

from runlens.llm import html_extract as hx

WEIGHTS = hx.shape_weights({})
LONG = "This is a sentence of the article that is long enough to be one, with some commas, and a full stop at its end."


def text_of(source):
    return hx.main_text(source, WEIGHTS)


def test_whole_table(spark):
    """Every page of the table, against the article cut out by expressions."""
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in hx.extract_text(df).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        body = re.search("<article>(.*?)(?:</article>|<footer|$)", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        want = "\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


@pytest.mark.parametrize("n", range(3, 9))
def test_minimum_cut(n):
    rnd = random.Random(n)
    for _ in range(60):
        excess = [rnd.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rnd.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5] + [(0, 1, 2), (1, 0, 1)]

        def cost(side):
            return (sum(max(0, x) for x, s in zip(excess, side) if not s) + sum(max(0, -x) for x, s in zip(excess, side) if s)
                    + sum(c for a, b, c in edges if side[a] != side[b]))
        every = [s for s in itertools.product((False, True), repeat=n)]
        least = min(map(cost, every))
        smallest = [all(s[i] for s in every if cost(s) == least) for i in range(n)]
        assert hx._max_flow_side(excess, edges) == smallest


def test_long_chain():
    """Thousands of undecided blocks: the flow has to find its way."""
    rnd = random.Random(1)
    n = 6000
    excess = [rnd.randint(-900, 900) for _ in range(n)]
    edges = [(i, i + 1, 900) for i in range(n - 1)]
    side = hx._max_flow_side(excess, edges)
    best = {0: (0 if excess[0] > 0 else abs(excess[0])), 1: (0 if excess[0] < 0 else abs(excess[0]))}
    keep, drop = max(0, -excess[0]), max(0, excess[0])
    for x in excess[1:]:
        keep, drop = min(keep, drop + 900) + max(0, -x), min(drop, keep + 900) + max(0, x)
    cost = sum(max(0, -x) if s else max(0, x) for x, s in zip(excess, side)) + 900 * sum(a != b for a, b in zip(side, side[1:]))
    assert cost == min(keep, drop) and best


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content">{}</div>',
                                    '<div role="main">{}</div>', '<div class="page-wrapper has-sidebar"><article>{}</article></div>',
                                    "<form action=x><article>{}</article></form>", "<div>{}</div>"])
def test_page_parts(around):
    article = (f"<header><h1>A  title &amp; more</h1></header><p>{LONG}<br>{LONG}<p><b>Sh &#233;t&eacute;.</b></p><script>x='<p>no</p>'</script>"
               f"<ul><li>{LONG}<li>Second&nbsp;point of the list, it is there too.</ul><!-- no <p>no</p> --><p>{LONG}</p>")
    page = (f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body class='header nav'><header><a href=/>Site</a></header>"
            f"<nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><div class='cookie-notice'>{LONG}</div>"
            f"<div class='ad'>{LONG}</div>{around.format(article)}<aside><p>{LONG}</p></aside><section id=comments><article><p>{LONG}</p></article></section>"
            f"<form><label>Name</label><button>Send</button><textarea>no</textarea></form><footer>&copy; {LONG}</footer>")
    want = ["A title & more", f"{LONG} {LONG}", "Sh été.", LONG, "Second point of the list, it is there too.", LONG]
    if around == "<div>{}</div>":   # nothing names the article: a header outside of one is the page's
        want = want[1:]
    assert text_of(page).split("\n") == want


def test_broken_markup():
    assert text_of(None) == text_of("") == text_of("   ") == text_of("<html><body></body></html>") == ""
    assert text_of(f"<article><p>{LONG}</div></p></span><p>a &lt;b&gt; < c & d &copy x {LONG}") == f"{LONG}\na <b> < c & d © x {LONG}"
    assert text_of(f"<article><p title=don't>{LONG}<p class=\"x>y\">{LONG}</article><!-- {LONG}") == f"{LONG}\n{LONG}"
    assert text_of(f"<article><p>{LONG}<script>{LONG}") == LONG
    assert text_of(f"<article><table><tr><td>{LONG}<td>{LONG}<tr><td>{LONG}</table></article>") == "\n".join([LONG] * 3)
    assert text_of(f"<ARTICLE><P>{LONG}</P><P>日本語の文章です。</P></ARTICLE>") == f"{LONG}\n日本語の文章です。"
    assert text_of("<article>" + f"<div><p>{LONG}</p>" * 3000) == "\n".join([LONG] * 3000)
    assert len(text_of(f"<p>{LONG}</p>" * 5000).split("\n")) == 5000
    assert text_of("<div>" * 20000 + "<article>" + LONG + "</div>" * 20000) == LONG
    assert text_of("<a href=\"" * 3000) == ""


def test_odd_tables(spark):
    rows = [(1, None, "u"), (None, "", None), (2, f"<article>{LONG}</article>", "u"), (2, f"<article>{LONG}</article>", "u"),
            (2 ** 60 + 1, f"<nav>x</nav><article>{LONG * 200}</article>", "v")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").selectExpr("*", "'clash' AS text", "'clash' AS n_chars", "'kept' AS h", "1 AS w")
    got = sorted(map(tuple, hx.extract_text(df).select("page_id", "url", "text", "n_chars", "h", "w").collect()), key=str)
    want = [(i, u, " ".join(re.sub("<nav>.*</nav>|<[^>]*>", "", x or "").split())) for i, x, u in rows]
    assert got == sorted([(*w, len(w[2]), "kept", 1) for w in want], key=str)
    assert hx.extract_text(df.limit(0)).collect() == []


def test_learned_shapes(spark):
    """What the marked pages show decides on pages that say nothing."""
    page = "<nav><p>go there now</p><p>and here too.</p></nav><article><ul><li>" + "</li><li>".join(f"{LONG} {i}" for i in range(9)) + "</li></ul></article>"
    w = hx.learn_shapes(spark.createDataFrame([(page,)] * 40, "html string"))
    assert w["tag:li"] > WEIGHTS["tag:li"] and w["words:0"] < WEIGHTS["words:0"] and w["tag:p"] < 0
