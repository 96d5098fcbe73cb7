import html
import re
import time

import numpy as np
import pytest

from tallyflow.llm.html_blocks import blocks
from tallyflow.llm.html_extract import extract, trained
from tallyflow.llm.html_samples import page as sample_page
from tallyflow.llm.registry import op1_extract_text
from tests.oracle import small


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> &nbsp; </p>") == []
    assert texts("a &lt;b&gt; &amp;amp; &#233;\t\n c") == ["a <b> &amp; é c"]
    assert texts("<p><b>one<br>two<p>three</b></p>x<i>y</i>z") == ["one two", "three", "xyz"]
    assert texts("<script>var t='</p>';</script>a<style>p{}</style><!-- <p>no --><textarea><p>q</textarea>b<title>t</title>") == ["ab"]
    assert texts("1 < 2 <3 <a href='x>y'>k</a><p") == ["1 < 2 <3 k"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>") == ["a", "b", "c", "d", "e", "f"]
    assert texts("<p>a</article></p><div class=\"x>b<p>c</p>\">d</div>") == ["a", "d"]
    assert texts("<p title='never closed>a</p><p>b</p>") == ["a", "b"]
    assert texts("<script>open") == texts("<!-- open") == []
    path = blocks("<div class='sideBar-2 X'><p id=a>t</p></div>")[0].path
    assert path == ("div side bar 2 x", "p a")
    assert blocks("<p>a <a>bc</a> d</p>")[0].linked == 2
    assert len(texts("<div>" * 20000 + "x" + "<p>y" * 2000)) == 2001


def test_learns_made_up_layouts():
    """All made-up pages; those whose parts have meaningless names, or no article, are counted by themselves."""
    rng = np.random.default_rng(5)
    pages, exact, n_blocks, right = (dict.fromkeys((True, False), 0) for _ in range(4))
    for _ in range(400):
        text, labels = sample_page(rng)
        found = blocks(text)
        assert len(found) == len(labels)
        if not labels:
            continue
        named = any(name in text for name in ("<article", "<main", "content", "article", "story"))
        good = trained().label([found])[0] == np.array(labels, bool)
        pages[named] += 1
        exact[named] += good.all()
        n_blocks[named] += len(good)
        right[named] += good.sum()
    for named in (True, False):
        print("named" if named else "others", "pages", pages[named], "exact", exact[named] / pages[named], "blocks right", right[named] / n_blocks[named])
    assert exact[True] / pages[True] > 0.97 and exact[False] / pages[False] > 0.7 and right[False] / n_blocks[False] > 0.96


def test_text_of_the_article_is_whole():
    assert texts("<p>Let <math><mi>x</mi></math> be and <object>fallback</object> <iframe>frame</iframe></p>") == ["Let x be and fallback frame"]
    assert texts("<xmp><b>&amp;</xmp>c<noscript>d</noscript><svg><title>t</title></svg>") == ["<b>&amp;", "cdt"]
    assert texts("a<plaintext>b</plaintext><p>c") == ["a", "b</plaintext><p>c"]


def test_hostile_markup_takes_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 100000 + "</p>" * 100000, "<i><div>" + "<b>" * 100000 + "</i>" * 100000, "<blockquote>" * 100000, "<div>" * 50000 + "x" + "<p>y" * 50000, "<p title='" * 50000, "<svg>" * 100000 + "<title>x"):
        blocks(page)
    assert time.perf_counter() - began < 20


def test_whole_table(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{small('sf0.01')}/pages.parquet").collect()}
    got = op1_extract_text(spark, small("sf0.01")).collect()
    assert len(got) == len(source)
    for r in got:
        inside = re.search(r"(?s)<article>(.*)</article>", source[r.page_id])[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inside)]
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text)


def test_other_layouts():
    page = """<html><head><title>T</title></head><body><header><h1>Site name</h1><p>A slogan.</p></header><nav><a>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <aside class="sidebar"><h3>Popular</h3><ul><li><a>One</a></li></ul></aside><form><label>Search</label><button>Go</button></form>
    <article><h1>Title &amp; more</h1><p>First   paragraph.</p><div class="ad">Buy now.</div><p>Second <b>one</b>.</p></article>
    <section class="comments"><h3>Comments</h3><p>I think that this is a nice article.</p></section><footer>&copy; all.</footer></body></html>"""
    found = blocks(page)
    marks = trained().label([found])[0]
    assert [b.text for b, m in zip(found, marks, strict=True) if m] == ["Title & more", "First paragraph.", "Second one."]


@pytest.mark.parametrize(("page", "wanted"), [
    ("<div class='xqz'><p>The council met on Monday and agreed on a new budget for the schools. It will be spent on teachers.</p></div>", [0]),
    ("<div class='a'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='xqz'><p>The council met on Monday and agreed on a new budget. It was late.</p>"
     "<p>Next year the plan will be reviewed by a committee of experts from the region.</p></div><div class='b'>Copyright 2020 Acme</div>", [1, 2]),
    ("<table><tr><td><a href='/'>Home</a><br><a href='/x'>About</a></td><td><h1>A long walk</h1><p>We left the village at dawn and walked along the river until noon.</p>"
     "<p>In the evening we came to a small inn where we stayed.</p></td></tr><tr><td colspan=2>Copyright 2003 John. All rights reserved.</td></tr></table>", [1, 2, 3]),
    ("<p>Only one paragraph of text that stands here alone, without anything.</p>", [0]),
    ("<nav><a>Home</a></nav>", []),
])
def test_pages_without_telling_names(page, wanted):
    assert np.flatnonzero(trained().label([blocks(page)])[0]).tolist() == wanted


def test_edges(spark):
    long = "<article>" + "<p>word and more.</p>" * 20000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><a>x</a></nav>"), (4, "u", long), (4, "u", long), (5, "u", "<article><p>é\U0001f600.</p></article>")]
    got = extract(spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int").coalesce(1), keep=["page_id", "url", "text"]).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", 0), (2, None, 0), (None, "u", 0), (4, "u", 20000 * 15 - 1), (4, "u", 20000 * 15 - 1), (5, "u", 3)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
