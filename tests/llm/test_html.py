"""Extraction on made-up hosts, odd markup and the given pages."""

import os
import re

import pytest

from foliotree.llm.html_consensus import Page, extract, page_votes, winning_paths

SCHEMA = "page_id long, url string, html string, text string"
FRAME = ('<html><head><title>no</title><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site <h2>Name</h2></header><nav><a href=x>menu</a></nav>'
         '<div class="cookie-notice">We use cookies</div><div class="{name}">{body}</div><div class="sidebar">{side}</div><footer>&copy; me</footer></body></html>')


def test_blocks_and_what_is_left_out():
    page = Page('''<main><article class="post"><header class="entry-header"><h1>T &amp; T</h1><span>by me</span></header><p>Hello&nbsp;<b>bold</b> w
  orld<p>second<br>line<!-- no --><ul><li>one<li>two</ul><form><p>field</p></form><aside>side</aside><div class="ad-box">buy</div>
  <table><tr><td>a<td>b</tr></table><style>p{}</style><section class="comments"><p>reader</p></section>&lt;p&gt; 5 < 6</article></main>''')
    assert page.extract(None)[0] == "T & T\n\nHello bold w orld\n\nsecond line\n\none\n\ntwo\n\na b\n\n<p> 5 < 6"


@pytest.mark.parametrize("source", ["", "   ", "<", "<p", "</p>", "<!--", "<script>x", "&", "<a href='", "<" * 500, "<p>" * 5000, "</div>" * 100, "<div class=\"a'>x</div>"])
def test_odd_markup(source):
    assert isinstance(Page(source).extract(["html>body"])[0], str)
    assert Page("<p>a" + source.replace("<script>x", "")).extract(None)[0][:1] in ("a", "")


def test_consensus_overrules_a_page(spark):
    long = "The sea was wide and nobody heard the lion of that time, it is said. "
    article = lambda n: "".join(f"<p>{long * 2}{i}</p>" for i in range(n))
    rows = [(i, f"https://H.example.com/{i}", FRAME.format(name=f"story-{i}", body=article(4), side="<p>more</p>"), "x") for i in range(12)]
    # Its own best container is the column beside the article; the host's pages know better.
    rows += [(50, "http://h.example.com/50", FRAME.format(name="story-50", body="<p>Short news.</p>", side="").replace(
        "</body>", f'<div class="more">{article(6)}</div></body>'), "x")]
    rows += [(51, "http://h.example.com/other", f"<html><body><section>{article(3)}</section></body></html>", "x"), (52, None, None, "x"), (53, "no url", "", "x"),
             (54, None, "<p>loose text", "x"), (0, "https://H.example.com/0", rows[0][2], "x")]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in extract(pages).collect()}
    assert extract(pages).count() == len(rows)
    assert got[0].text == "\n\n".join(f"{long * 2}{i}" for i in range(4)) and got[0].path == "html>body>div.story-N"
    assert got[50].text == "Short news."
    assert got[51].text.startswith("The sea") and got[52].text == got[53].text == "" and got[54].text == "loose text"
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[52].url is None
    won = {r.host: r.winners for r in winning_paths(page_votes(pages)).collect()}
    assert won["h.example.com"] == ["html>body>div.story-N"]
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_given_pages(spark):
    """These pages have one article each; its tags taken off must give the same words."""
    import html as references

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", source[r.page_id])[1]
        assert r.text.split() == references.unescape(re.sub(r"<[^>]*>", " ", inner)).split()
        assert "\n\n" not in r.text.replace("\n\n", "", r.text.count("\n\n")) and r.text == r.text.strip()
