"""Comments, boxes, forgotten ends and very deep elements."""

import time

import pytest

from foliotree.llm.html_consensus import MAX_DEPTH, Page

TEXT = "The sea was wide and nobody heard the lion of that time, it is said."
REMARK = "I have read this more than once and do not agree with a word of it, as I said before."


def blocks(source):
    return Page(source).extract(None)[0].split("\n\n")


def paragraphs(text, n):
    return "".join(f"<p>{text} {i}</p>" for i in range(n))


def wanted(n):
    return [f"{TEXT} {i}" for i in range(n)]


@pytest.mark.parametrize("page", [
    '<div class="post">{post}</div><div class="comments">{remarks}</div>',
    "<main><div>{post}</div><div id='comments'>{remarks}</div></main>",
    "<main>{post}<section class='comment-list'>{remarks}</section></main>",
    "<article>{post}</article><div class='disqus'><div class='replies'>{remarks}</div></div>",
    "<article>{post}<div class='comments'><article class='comment'>{remarks}</article></div></article>",
])
@pytest.mark.parametrize("share", [1, 5, 30])
def test_comments_go_however_long_they_are(page, share):
    source = "<html><body>" + page.format(post=paragraphs(TEXT, 1), remarks=paragraphs(REMARK, share)) + "</body></html>"
    assert blocks(source) == wanted(1)


def test_a_page_of_comments_only_is_not_lost():
    assert len(blocks(f"<body><h1>Talk</h1><div class='comments'>{paragraphs(REMARK, 4)}</div></body>")) >= 4


def test_a_box_longer_than_the_article_does_not_replace_it():
    box = paragraphs("Subscribe to our weekly letter and never miss what we have to say about the world.", 4)
    assert blocks(f"<body><div class='entry-content'>{paragraphs(TEXT, 2)}</div><div class='newsletter'>{box}</div></body>") == wanted(2)
    assert len(blocks(f"<body><div class='newsletter'>{paragraphs(TEXT, 5)}</div></body>")) == 5


@pytest.mark.parametrize("tag", ["nav", "aside", "footer"])
def test_a_forgotten_end_does_not_swallow_the_page(tag):
    menu = f"<{tag}><ul><li><a href='/'>Home</a></li><li>About us</li></ul>"
    assert blocks(f"<body>{menu}<div class='post'>{paragraphs(TEXT, 5)}</div></body>") == wanted(5)
    assert blocks(f"<body>{menu}</{tag}><div class='post'>{paragraphs(TEXT, 5)}</div></body>") == wanted(5)
    # At the end of a page what follows is its own.
    assert blocks(f"<body><div class='post'>{paragraphs(TEXT, 5)}</div><footer>All rights<p>of this page</body>") == wanted(5)


def test_what_is_very_deep_is_judged_like_anything_else():
    deep = "<div>" * (MAX_DEPTH + 500)
    inner = f"<nav><p>{REMARK}</p></nav><div class='comments'><p>{REMARK} x</p></div><script>var a</script>{paragraphs(TEXT, 6)}"
    assert blocks(f"<body>{deep}{inner}") == wanted(6)


def test_depth_costs_time_in_proportion():
    def seconds(n):
        begin = time.perf_counter()
        Page("<div>" * n + "text" + "</b></div>" * n)
        Page("<b>" * n + "text" + "</i>" * n)
        return time.perf_counter() - begin
    seconds(1000)
    assert seconds(80_000) < 20 * seconds(20_000) + 1
