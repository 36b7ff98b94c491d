"""The quality votes and the HTML query against plain loops over whole tables."""

import os
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from foliotree.llm import quality as q
from foliotree.llm.html_consensus import Page
from foliotree.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def kind(byte):
    c = chr(byte)
    if c.islower() and byte < 128 or byte >= 128:
        return "lower"
    if c.isupper():
        return "upper"
    if c.isdigit():
        return "digit"
    if c in " \t\n\r\x0b\x0c":
        return "blank"
    if c in ".,;:'\"-()?":
        return "prose"
    return {"!": "shout", "|": "pipe"}.get(c, "symbol")


def slow_votes(data):
    words = data.split()
    n = len(words)
    if not n:
        return (q.ABSTAIN,) * 10
    count = Counter(kind(b) for b in data)
    same = [i > 0 and words[i] == words[i - 1] for i in range(n)]
    repeats = sum(same) / n
    runs = sum(same[i] or (i + 1 < n and same[i + 1]) for i in range(n)) / n
    letters = max(1, count["lower"] + count["upper"])
    ends = [kind(w[-1]) for w in words]
    odd = sum(e in ("shout", "pipe", "symbol") for e in ends) / n
    marks = sum(len(w) == 1 and kind(w[0]) in ("prose", "shout", "pipe", "symbol") for w in words) / n
    shown = len(data) - count["blank"]
    plain = letters + count["digit"] + count["prose"]
    varied = count["upper"] < max(3, 0.3 * letters) and repeats < 0.2 and runs < 0.35
    text = data.decode()
    sentences = len(re.findall(r"[.?!](?=[ \n])|[.?](?=\" )|\.(?=\) )|[।॥؟۔։።…]", text)) + text.endswith((".", "?", "!"))
    lines = text.count("\n")
    junk = lambda x: q.JUNK if x else q.ABSTAIN
    return (junk(count["symbol"] > 0.4 * n), junk(odd > 0.3), junk(count["upper"] > 0.4 * letters), junk(count["shout"] > 0.3 * n), junk(count["pipe"] > 0.3 * n),
            junk(marks > 0.2), junk(n >= 8 and repeats > 0.3), junk(n >= 8 and runs > 0.45),
            q.CLEAN if plain > 0.95 * shown and varied else junk(plain < 0.85 * shown),
            q.ABSTAIN if n < 30 else q.CLEAN if n < 40 * sentences and varied else junk(n > 100 * (sentences + lines)))


def test_votes_of_all_documents():
    texts = [(t or "").encode() for t in pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()]
    seen = Counter()
    for data in texts:
        if q.spaced(data) is data:
            assert q.votes(data) == slow_votes(data)
            seen.update(enumerate(slow_votes(data)))
    assert len(seen) > 15


def test_html_by_plain_loops(spark):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    host = lambda u: m[1].lower() if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "")) else ""
    votes = defaultdict(Counter)
    for p in pages:
        page = Page(p["html"] or "")
        top, score = page.best()
        if score > 0 and host(p["url"]):
            votes[host(p["url"])][page.paths[top]] += 1
    expected = {}
    for p in pages:
        own = votes[host(p["url"])]
        ranked = sorted(own.items(), key=lambda x: (-x[1], x[0]))
        winners = [k for k, n in ranked if n >= 0.2 * sum(own.values())]
        known = [k for k, n in ranked if n >= 2 and 100 * n >= sum(own.values())]
        text, _ = Page(p["html"] or "").extract(winners or None, known)
        expected[p["page_id"]] = (p["url"], text, len(text))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op3_html"](spark, DATA).collect()}
    assert got == expected
