import itertools
import random
import re
from html import unescape

from tidemark.llm import queries
from tidemark.llm.html_cut import blocks, extract, main_text, min_cut

SF = "/root/testdata/sf0.001"


def test_min_cut_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        scores = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.uniform(0, 1.5)) for _ in range(rnd.randrange(0, 14))]
        cost = lambda x: sum(max(0, s) * (not k) + max(0, -s) * k for s, k in zip(scores, x)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(min_cut(scores, edges)) - best) < 1e-9


def test_query_gives_the_articles(spark):
    pages = {p.page_id: p for p in queries.read(spark, SF, "pages").collect()}
    got = queries.QUERIES["op10_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S).group(1)
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?p>|</?h1>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><a href="/">Logo</a></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div id="cookie-notice">We use cookies to track you all over the wide web. Please accept them now.</div>
<main><article><h1>Big   &amp; small</h1><p>First paragraph&nbsp;with <b>bold</b>text, and enough words to be read.
<p>Second one &lt;tag&gt; is here.<script>var x="</p><p>no</p>";</script><div class="ad">Buy now! A very good offer for you and all of your friends, only today.</div>
<p>Short.</p><form><label>Name</label><input name="q"></form><section class="comments"><p>I am a reader and I like what you wrote here, thank you so much.</p></section></article></main>
<aside><p>Other stories that you may like to read on this site, if you have the time.</p></aside><footer>&copy; 2020 All rights.</footer></body></html>"""


def test_furniture_goes():
    assert main_text(PAGE)[0] == "Big & small\n\nFirst paragraph with boldtext, and enough words to be read.\n\nSecond one <tag> is here.\n\nShort."


def test_pages_without_landmarks_keep_their_prose():
    text = "This is a rather long paragraph of prose that goes on for quite a while, as articles do. " * 3
    html = f'<div><a href="/1">Home</a> <a href="/2">About</a></div><div><p>{text}</p><p>{text}</p></div><div class="footer">Contact</div>'
    assert main_text(html)[0] == "\n\n".join([text.strip()] * 2)


def test_edge_cases(spark):
    odd = ["", "   ", "<", "<p", "<!-- never closed <p>x</p>", "<script>x", "plain", "<p>a<p>b" * 3, "</p></div>", '<p class="x>broken <b>y</b>', "&#0;&bogus;&amp", "<p>" * 5000, "<p>" + "word " * 100_000]
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate([None, *odd])] + [(None, None, PAGE, "x"), (0, "u", None, "x")], "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert len(got) == len(odd) + 3 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 0] == ["", ""] and got[-2].text.startswith("Big & small")
    assert next(r for r in got if r.page_id == len(odd)).n_chars == 499_999
    assert extract(df.limit(0)).count() == 0
    assert [b.text for b in blocks("<p>a<br>b<i>c</i></p>d")] == ["a bc", "d"]


def test_open_marked_sections_take_linear_time():
    import time

    page = "<p>" + "<![CDATA[ x " * 40_000
    start = time.time()
    assert blocks(page) == [] and time.time() - start < 10
    assert main_text("<main><p><![CDATA[A text that stands in a marked section.]]> And more words. <![CDATA[ open > Rest of it all.</p></main>")[0].endswith("Rest of it all.")
    start = time.time()
    blocks("<i>" * 30_000 + "</u>" * 30_000)
    assert time.time() - start < 10
