import html
import re
import time

import pytest

from weftline.llm import html_text
from weftline.llm.html_text import blocks_of, extract_main_text, main_text, op5_html, path_scores

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body>%s</body></html>"
ARTICLE = "<article><h1>Head line</h1><p>First, a paragraph with some words.<p>Second &amp; last;&nbsp;with <b>bold</b>\n  text.<br>And more.</p><p>Ti.</p></article>"
TEXT = "Head line First, a paragraph with some words. Second & last; with bold text. And more. Ti."
NOISE = (
    "<nav><ul><li><a href='/a'>Menu one</a></li></ul></nav>",
    "<header><h2>Site name, a header.</h2></header>",
    "<div class=\"ad\">Buy this, now. Really, do buy it.</div>",
    "<aside><p>A side bar, with words and points.</p></aside>",
    "<div class='sidebar widget'><p>Another bar, with some words.</p></div>",
    "<div id=cookie-notice>We use cookies, as others do. Accept.</div>",
    "<form><label>Search, please.</label><input name=q></form>",
    "<section id='comments'><div class='comment'><p>I read this, and liked it. Very much so.</p></div></section>",
    "<footer>&copy; Example, all rights reserved.</footer>",
    "<!-- ad 1 --><noscript>Please enable, if you can.</noscript>",
)


@pytest.mark.parametrize("before", NOISE)
def test_noise_goes(before):
    assert main_text(PAGE % (before + ARTICLE)) == TEXT
    assert main_text(PAGE % (ARTICLE + before)) == TEXT
    assert main_text(PAGE % ARTICLE.replace("</article>", before + "</article>")) == TEXT or before.startswith("<header")


def test_all_noise_and_no_article():
    plain = ARTICLE.replace("article>", "div>")
    assert main_text(PAGE % ("".join(NOISE[:5]) + plain + "".join(NOISE[5:]))) == TEXT


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain words, no tags", "plain words, no tags"), ("a < b & c", "a < b & c"), ("<div>open <p>and unclosed", "open and unclosed"), (PAGE % "<nav>x</nav>", ""), ("<p>1 &lt;2&gt; &#233; &eacute;</p>", "1 <2> é é"), ("<p>a</b></i> b</p></div>", "a b")])
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_wrappers_that_speak_of_a_side_bar_stay():
    inner = ARTICLE.replace("article>", "div>")
    assert main_text(PAGE % f"<div class='header'>Site, here.</div><div class='page with-sidebar no-ads'>{inner}<div class='sidebar'>Side, bar.</div></div>") == TEXT


def test_long_pages_are_whole():
    body = "".join(f"<p>Paragraph {k}, of many.</p>" for k in range(5000))
    assert main_text(PAGE % f"<article>{body}</article>") == " ".join(f"Paragraph {k}, of many." for k in range(5000))
    assert main_text("<div>" * 3000 + "deep words" + "</div>" * 3000) == "deep words"


def test_table_pages(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op5_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inside)).split())
        assert " ".join(r.text.split()) == want and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, None, "<p>a b</p>", "x", 3), (None, "u", None, "y", 4), (1, None, "<p>a b</p>", "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_main_text(df).collect()) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3)]
    assert extract_main_text(df.limit(0)).count() == 0


LONG = "<p>A paragraph, with some words and more of them. It goes on, as paragraphs do; at some length.</p>"
CONTENT = f"<div class='content'>{LONG * 4}</div>"


def plain(text):
    return " ".join(re.sub(r"<[^>]*>", " ", text).split())


def test_the_ratios_decide(spark, sf_dir, monkeypatch):
    tags = "<div class='x'>one</div><div class='x'>two</div><div class='x'>three</div><div class='x'>four</div><div class='x'>five</div>"
    assert main_text(PAGE % (tags + CONTENT)) == plain(CONTENT)
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    before = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "path_scores", lambda blocks: {n.path: 1.0 for n, _, _ in blocks})
    assert main_text(PAGE % (tags + CONTENT)) == plain(tags + CONTENT)
    assert [main_text(p) for p in pages] != before


def test_path_scores_by_hand():
    blocks = blocks_of("<div><p>Ab, cd.</p><p>Efgh.</p></div><ul class='ad'><li>x</li></ul>")
    assert [(b[0].name, b[1]) for b in blocks] == [("p", "Ab, cd."), ("p", "Efgh."), ("li", "x")]
    length, marks = [6.0, 6.0, 1.0], [1.5, 1.5, 0.0]
    weight = {0: 1.0, 1: 0.35, 2: 0.1}

    def smooth(values, k):
        return sum(weight[abs(j - k)] * v for j, v in enumerate(values)) / sum(weight[abs(j - k)] for j in range(3))

    fused = [(smooth(length, k) * (1 + smooth(marks, k))) ** 0.5 for k in range(3)]
    got = path_scores(blocks)
    assert got[blocks[0][0].path] == pytest.approx((fused[0] + fused[1]) / 2) and got[blocks[2][0].path] == pytest.approx(0.1 * fused[2])


@pytest.mark.parametrize("prose", [
    "<p class='related-work'>This was done before, by others. They say so, at length, in a book.</p>",
    "<div id='share-of-vote'>The vote was, in the end, a tie. No one had foreseen it.</div>",
    "<p class='search-results-note'>The results, as noted, vary.</p>",
    "<div class='head'><h1>Title</h1></div>",
    "<div class='lead'><p>A lead, in short.</p></div>",
])
def test_names_alone_drop_no_prose(prose):
    assert main_text(PAGE % (prose + CONTENT)) == plain(prose + CONTENT)


def test_all_content_stays_wherever_it_lies():
    two = f"<article>{LONG * 3}</article><article>{LONG * 2}<p>End.</p></article>"
    assert main_text(PAGE % two) == plain(two)
    assert main_text(PAGE % (CONTENT + f"<article>{LONG * 6}</article>")) == plain(CONTENT + LONG * 6)
    listed = f"<div class='content'>{LONG * 3}<ul><li><a href='/x'>A reference</a></li></ul></div>"
    assert main_text(PAGE % listed) == plain(listed)
    assert main_text(PAGE % (CONTENT + "<ul><li><a href='/x'>A link</a></li></ul>")) == plain(CONTENT)
    comments = f"<section id='comments'>{LONG * 9}</section>"
    assert main_text(PAGE % (CONTENT + comments)) == plain(CONTENT)


@pytest.mark.parametrize("odd", ["<a " * 100_000, "<div>" * 20_000 + "x", "<div>" * 20_000 + "x" + "</div>" * 20_000, "<div>" * 3_000 + "<li>a</li>" * 20_000, "<a \">'<a \"" * 20_000, '<a "' * 50_000, "<!--" * 50_000, "<noscript>" * 50_000, "<div><p>a</p></section>" * 10_000])
def test_odd_pages_take_time_in_proportion(odd):
    began = time.process_time()
    main_text(odd)
    assert time.process_time() - began < 10
    assert len({n.path for n, _, _ in blocks_of(odd)}) <= 20_000
