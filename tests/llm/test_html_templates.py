"""Hosts with several templates, pages without a host, articles in parts."""

from foliotree.llm.html_consensus import Page, extract

TEXT = "The sea was wide and nobody heard the lion of that time, it is said."
body = lambda n: "".join(f"<p>{TEXT} {i}</p>" for i in range(n))
lines = lambda n: "\n\n".join(f"{TEXT} {i}" for i in range(n))


def test_the_winner_with_most_text():
    page = Page(f'<body><div class="lead"><p>Short teaser.</p></div><div class="story">{body(6)}</div></body>')
    assert page.extract(["html>body>div.lead", "html>body>div.story"]) == (lines(6), "html>body>div.story")


def test_a_teaser_at_the_other_templates_path():
    page = Page(f'<body><div><p>Short teaser.</p></div><article>{body(6)}</article></body>')
    assert page.extract(["html>body>div"]) == (lines(6), "html>body>article")


def test_the_smaller_template_is_known_and_no_host_is_no_host(spark):
    large = [(i, f"http://h/{i}", f'<div class="lead">{body(5)}</div>') for i in range(30)]
    small = [(100 + i, f"http://h/s{i}", f'<div class="lead"><p>Teaser.</p></div><div class="b">{body(6)}</div>') for i in range(3)]
    none = [(200 + i, None, f'<div class="x">{body(5)}</div>') for i in range(9)] + [(300, None, f'<div class="x"><p>{TEXT}</p></div><div class="y">{body(3)}</div>')]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(large + small + none, "page_id long, url string, html string")).collect()}
    assert got[0] == lines(5) and got[100] == lines(6) and got[200] == lines(5) and got[300] == lines(3)


def test_parts_are_put_together():
    page = Page(f'<div class="w"><div class="first">{body(9)}</div><div class="second">{body(2)}</div><ul><li><a href="x">link</a></ul></div>')
    assert page.extract(None)[0].startswith(lines(9) + "\n\n" + lines(2))
