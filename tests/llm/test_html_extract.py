"""Main text of pages: the article without its surroundings, templates by host, odd pages."""

import html
import re

from siltstone.llm import html_extract as H
from siltstone.llm import queries


def test_pages(spark, sf, as_rows):
    got = {r["page_id"]: r for r in as_rows(queries.op9_html(spark, sf))}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner))
        assert got[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><div class="menu"><a href="/">Home</a> <a>News</a></div>
<div class="cookie-notice">We use cookies</div><div id="c"><h1>Title {n}</h1><p>Body &amp; soul of <b>page</b> {n},
 with a   long enough text to be the main one.</p><p>Second {n} &#8212; paragraph &lt;ok&gt;.</p><p>Follow us on the usual networks</p></div>
<div class="comments"><p>nice {n}</p></div><form><input>send</form><script>var x = "<p>no</p>";</script><footer>&copy; us</footer></body></html>"""


def test_template_of_a_host(spark, as_rows):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in as_rows(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    for i in range(6):
        assert got[i] == f"Title {i}\nBody & soul of page {i}, with a long enough text to be the main one.\nSecond {i} — paragraph <ok>."


def test_template_inside_articles(spark, as_rows):
    page = "<body><div>Top of the host</div><article><h1>Title {n}</h1><p>Body of page {n}.</p><p>{own}</p><div>Share this story</div></article></body>"
    rows = [(i, f"http://h.example/{i}", page.format(n=i, own="a notice that most share" if i else "an own one")) for i in range(5)]
    rows += [(10 + i, f"http://same.example/{i}", page.format(n=1, own="x")) for i in range(4)]
    rows += [(20 + i, f"http://mixed.example/{i}", page.format(n=i if i < 3 else 9, own="y")) for i in range(8)] + [(30, "http://mixed.example/", "<p>index</p>")]
    got = {r["page_id"]: r["text"] for r in as_rows(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    for i in range(5):
        assert got[i] == f"Title {i}\nBody of page {i}.\n" + ("a notice that most share" if i else "an own one")
    assert got[10] == "Title 1\nBody of page 1.\nx\nShare this story"
    assert [got[20 + i] for i in range(8)] == [f"Title {n}\nBody of page {n}." for n in (0, 1, 2, 9, 9, 9, 9, 9)]


def test_all_slots_without_a_main_element(spark, as_rows):
    page = """<body><div class="menu">Home</div><div class="content"><h1>Title {n}</h1><div class="body"><p>Text {n} of some length.</p></div></div>
<div id="s1"><p>First {n}</p></div><div id="s2"><p>Second {n}, a longer section.</p></div><p>Same on all pages</p></body>"""
    rows = [(i, f"http://h.example/{i}", page.format(n=i)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in as_rows(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    for i in range(4):
        assert got[i] == f"Title {i}\nText {i} of some length.\nFirst {i}\nSecond {i}, a longer section."


def test_odd_pages(spark, as_rows):
    rows = [
        (1, None, None), (2, "not a url", ""), (3, "http://x.y/", "<p>unclosed <b>bold<p>next"), (4, "http://x.y/", "plain text"),
        (4, "http://x.y/", "plain text"), (None, "http://x.y/", "<article><p>a</p><aside>b</aside><nav>c</nav></article><p>out</p>"),
        (6, "http://x.y/", "<!-- only a comment"), (7, "http://x.y/", "<script>never closed"), (8, "http://x.y/", "<p>" + "long " * 50_000),
    ]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0, r["text"][:40], r["n_chars"]) for r in as_rows(out)))
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "unclosed bold\nnext", 18), (4, "plain text", 10), (4, "plain text", 10), (0, "a", 1), (6, "", 0), (7, "", 0), (8, ("long " * 8)[:40], 249_999)])
    assert as_rows(H.extract(df.limit(0))) == []


def test_clashing_columns(spark, as_rows):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>text</p>", "x", "y", "z")], "page_id long, url string, html string, template string, host string, page string")
    assert [(r["template"], r["host"], r["page"], r["text"]) for r in as_rows(H.extract(pages))] == [("x", "y", "z", "text")]


def test_attributes_are_read_whole():
    """Names within other names or within values say nothing of an element."""
    kept = [
        '<p title="a hidden valley">text</p>', '<div data-hidden="false">text</div>', '<div data-id="menu">text</div>', '<p data-class=menu title=hidden>text</p>',
        "<p title='class=\"menu\" hidden'>text</p>", '<div my-role="navigation" xclass="footer">text</div>', "<p lang=en>text</p>",
    ]
    gone = ['<p hidden>text</p>', '<div HIDDEN="">text</div>', '<div title="x"class="menu">text</div>', "<div class = 'a menu'>text</div>", "<div id=sidebar>text</div>", '<p style="color:red; display: none">text</p>', '<div aria-hidden="true">text</div>']
    assert [H.article(x, set()) for x in kept] == [["text"]] * len(kept)
    assert [H.article(x, set()) for x in gone] == [[]] * len(gone)
