"""Extraction on whole pages against their template, the cut against all labellings."""

import html
import random
import re
from collections import Counter

import pytest
from gantry.llm import html_extract as h


def test_the_cut_is_the_cheapest_labelling():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        weights = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(12)) if a != b]

        def cost(keep):
            return sum(abs(w) for w, k in zip(weights, keep) if (w > 0) != k and w) + sum(c for a, b, c in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(h.minimum_cut(weights, edges)) == best


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="sidebar">
<header><h1>Site</h1><form><p>Search here for all of our long stories.</p></form></header>
<div id="cookie-notice"><p>We use cookies so that this site works better for you and everyone.</p></div>
<div class="layout"><ul class="menu"><li><a href="/">Home</a><li><a href="/b">About</a></ul>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>   words,<br>and
more.<p>Short.<!-- no --><table><tr><td>1<td>2</table><ul><li>x<li>y &lt; z</ul><p>&copy3 caf&eacute; &#x41;&#66;</p>
<div class="ad-box">Buy now.</div><div class="comments"><p>A reader says that this was a very good read indeed, thank you all.</p></div></article>
<aside><p>Other stories that you could like to read as well.</p></aside></div><footer>&copy; us</footer></body></html>"""


def test_a_page_keeps_its_article_only():
    assert h.extract_text(PAGE) == "Title & more\nFirst bold words, and more.\nShort.\n1\n2\nx\ny < z\n©3 café AB"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain text", "plain text"), ("<p>a < b > c", "a < b > c"), ("<p>cut off <a href=", "cut off"),
    ("<article><p>one</p></b></div><p>two", "one\ntwo"), ("<p>a<script>never closed", "a"), ("<!-- never closed <p>x", ""),
    ("<p title='it>s'>x</p>", "x"), ("<p it's>x</p>", "x"), ("<div hidden><p>no</p></div><p>yes it is shown</p>", "yes it is shown"),
    ("<article><p>a</p><p>" + "word " * 200_000 + "</p></article>", "a\n" + ("word " * 200_000).strip()),
])
def test_edges(page, text):
    assert h.extract_text(page) == text


def test_deep_and_broken_nesting_is_read_in_linear_time():
    assert h.extract_text("<div>" * 50_000 + "deep text here.") == "deep text here."
    assert h.extract_text("<article>" + "<p>x" * 30_000).count("\n") == 29_999


def test_a_table_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(None, None, None), (-1, "u", ""), (-1, "u", "")], pages.schema)
    found = h.extract(pages.unionByName(extra).selectExpr("*", "'x' AS text", "1 AS n_chars"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in rows if not r["text"]) == [("-1", ""), ("-1", ""), ("None", "")]
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        if r["text"]:
            article = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r["page_id"]], re.S).group(1)
            parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
            assert r["text"] == "\n".join(filter(None, parts))
    assert h.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article>", "so x=1 holds"),
    ("<article><p>a</p><xmp>b &lt; <b>c</b>\n d</xmp><p>e</article>", "a\nb &lt; <b>c</b> d\ne"),
    ("<article><xmp>never <closed", "never <closed"),
    ("<article><p>v: <video src=x>no player, see the text</video> w: <object><p>fallback</p></object></article>",
     "v: no player, see the text w:\nfallback"),
    ("<article><noscript><p>A picture of a bridge.</p></noscript><p>x</p></article>", "A picture of a bridge.\nx"),
    ("<noscript>Turn on scripts to go on.</noscript><article><p>x</p></article>", "x"),
    ("<article><p>a<audio>b</audio><canvas>c</canvas><svg><text>d</text></svg><button>e</button></article>", "abc"),
])
def test_text_that_stands_in_for_media_and_formulas_is_kept(page, text):
    assert h.extract_text(page) == text


NAMES = re.compile(r"<(/?)(article|main|nav|aside|footer|header|form|menu|dialog)\b")
ATTRIBUTES = re.compile(r"\s(class|id|role|hidden|aria-hidden)=(\"[^\"]*\"|'[^']*')")


def renamed(page):
    return ATTRIBUTES.sub("", NAMES.sub(r"<\1div", page))


def all_div(page):
    return re.sub(r"<(/?)(p|h1|ul|li)\b", r"<\1div", renamed(page))


@pytest.fixture(scope="module")
def given(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return pages, [r["html"] for r in pages.collect() if r["html"]]


@pytest.fixture(scope="module")
def costs(given):
    return h.fit(given[0], 100)


def f1(pages, change, costs):
    """F1 of blocks against those of the page as it was, and the number of blocks that the cut labels against their own cost."""
    right = found = wanted = changed = 0
    for page in pages:
        want = Counter(h.extract_text(page, costs).split("\n"))
        blocks = h.blocks(change(page))
        weights, keep = h.label_blocks(blocks, costs)
        got = Counter(b.text for b, k in zip(blocks, keep) if k)
        right, found, wanted = right + (want & got).total(), found + got.total(), wanted + want.total()
        changed += sum((w > 0) != k for w, k in zip(weights, keep))
    return 2 * right / (found + wanted), changed


def test_text_and_neighbours_decide_where_markup_is_silent(given, costs):
    pages = given[1]
    assert f1(pages, renamed, costs)[0] >= 0.98 > f1(pages, renamed, h.FIXED)[0]
    score, changed = f1(pages, all_div, costs)
    assert score >= 0.95 and changed > 0


def test_markup_outweighs_what_was_fitted(given, costs):
    assert all(h.extract_text(p, costs) == h.extract_text(p) for p in given[1])
    assert h.extract_text(PAGE, costs) == h.extract_text(PAGE)
    assert h.CLIP + 2 * h.NEAR < 4 and h.CLIP + 2 * 2 * h.FAR < 4 and max(costs.edges) <= h.NEAR


def test_fit_is_the_counts_of_the_sample(spark, given, costs):
    pages, _ = given
    assert h.fit(pages.repartition(7), 100) == costs
    assert h.fit(pages.unionByName(pages).withColumn("n", h.F.lit(1)), 100) == costs  # rows that share id and url count once
    whole = Counter()
    for r in pages.collect():
        whole.update(h.observe(h.blocks(r["html"] or "")))
    assert h.fit(pages, 10**6) == h.costs_of(whole)
    assert h.fit(pages.limit(0)) == h.FIXED
    plain = spark.createDataFrame([(1, "u", "<p>no markup speaks</p>"), (None, None, None)], "page_id bigint, url string, html string")
    assert h.fit(plain) == h.FIXED
