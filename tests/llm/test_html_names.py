"""Names and forms are votes: they cost no article text."""

import pytest

from foliotree.llm.html_consensus import Page

TEXT = "The sea was wide and nobody heard the lion of that time, it is said."
BODY = "".join(f"<p>{TEXT} {i}</p>" for i in range(8))
WANTED = [f"{TEXT} {i}" for i in range(8)]


def blocks(source):
    return Page(source).extract(None)[0].split("\n\n")


@pytest.mark.parametrize("wrapper", ['<div class="content has-sidebar">{}</div>', '<div class="no-comments">{}</div>', '<div class="sidebar content">{}</div>',
                                     "<form>{}</form>", "<form><article>{}</article></form>", "<nav><main>{}</main></nav>", "<aside><article>{}</article></aside>"])
def test_wrappers_lose_no_page(wrapper):
    assert blocks(f"<html><body>{wrapper.format(BODY)}</body></html>") == WANTED


def test_parts_of_an_article_stay():
    inner = f'<h2 id="related-work">Related</h2><section id="discussion"><p>{TEXT} d</p></section><p class="legal">law</p>'
    assert blocks(f"<article>{BODY}{inner}</article>") == [*WANTED, "Related", f"{TEXT} d", "law"]


def test_small_and_linked_parts_still_go():
    around = '<div class="share">Share this</div><ul class="related"><li><a href="x">' + "Another story " * 12 + '</a></ul><div style="display:none"><article>no</article></div>'
    assert blocks(f"<main>{BODY}{around}<form>Mail <input></form></main>") == WANTED
