"""Random model responses against plain Python that follows the rules of README and SURVEY."""

import json
import random
import re

from pyspark.sql import functions as F

from foliotree.operators import retrieval, summaries, tree

SCALARS = [1, 2, -1, 0, 7, 2.5, "2", "", "x y", "ü😀", None, True, False]
ODD = [[], {}, [1], {"a": 1}, ["p", "q"], 12345678901]


def noisy(rnd, text):
    """Wrap a JSON text the way models do, or break it."""
    form = rnd.randrange(12)
    if form == 0:
        return "Sure:\n" + text + "\nDone."
    if form == 1:
        return '<think>[1] {"a": 2}</think>' + text
    if form == 2:
        return text + " and " + text
    if form == 3:
        return text[:-1]
    if form == 4:
        return "no data"
    if form == 5:
        return None
    if form == 6:
        return text.replace(",", ",,", 1)
    return text


def span(response, opening, closing):
    if response is None:
        return None
    text = re.sub(r"<think>.*?</think>", "", response, flags=re.S)
    start, end = text.find(opening), text.rfind(closing)
    if start < 0 or end < start:
        return None
    try:
        return json.loads(text[start:end + 1])
    except ValueError:
        return None


def some(rnd, fields):
    """An object with some of the fields, each from its own pool."""
    return {k: rnd.choice(pool) for k, pool in fields.items() if rnd.random() < 0.75}


PAGE_NUMBERS = [1, 2, 3, 4, 6, 9, 9, 1, 2]


def test_ranges(spark):
    rnd = random.Random(3)
    responses = []
    for _ in range(400):
        wild = rnd.random() < 0.3
        pool = PAGE_NUMBERS + (SCALARS + ODD if wild else [])
        items = [some(rnd, {"page_start": pool, "page_end": pool, "reason": ["r", "", None, "s"]}) for _ in range(rnd.randrange(8))]
        if rnd.random() < 0.1:
            items.insert(rnd.randrange(len(items) + 1), rnd.choice(SCALARS + ODD))
        responses.append(noisy(rnd, json.dumps(items)))

    def pick(rank, item):
        """(rank, first, last, reason), or None where the item spoils the list."""
        if type(item) is not dict:
            return None
        known = {"page_start": 1, "reason": "", **item}
        known.setdefault("page_end", known["page_start"])
        pages = known["page_start"], known["page_end"]
        return (rank, *map(int, pages), known["reason"]) if {type(p) for p in pages} <= {int, bool} else None

    def expected(response):
        items = span(response, "[", "]")
        if items is None:
            return None
        picks = [pick(n + 1, item) for n, item in enumerate(items) if n < 5]
        return None if None in picks else picks

    df = spark.createDataFrame(list(enumerate(responses)), "i int, response string")
    got = {r.i: None if r.ranges is None else [tuple(x) for x in r.ranges] for r in retrieval.decode_ranges(df).collect()}
    wrong = [(responses[i], got[i], expected(r)) for i, r in enumerate(responses) if got[i] != expected(r)]
    assert not wrong, wrong[:3]
    assert sum(v is None for v in got.values()) > 50 and sum(bool(v) for v in got.values()) > 50


def test_summaries(spark):
    rnd = random.Random(4)
    responses = []
    for _ in range(400):
        data = some(rnd, {"summary": SCALARS + ["fine", "good"], "key_topics": [["a"], ["a", "b"], [], "ab", "", None, 3, [1], ["a", None], True], "has_tables": [True]})
        responses.append(noisy(rnd, json.dumps(data, ensure_ascii=rnd.random() < 0.5)))
    opening = "o" * 60

    def expected(response):
        data = span(response, "{", "}")
        if data is None:
            return f"Page 1: {opening}... (Topics: )", False
        known = {"summary": "", "key_topics": [], **data}
        if known["summary"] in (None, "", 0, False):
            return "", False
        if type(known["key_topics"]) not in (list, str) or {type(x) for x in known["key_topics"]} - {str}:
            return None, True
        return "".join(["Page 1: ", str(known["summary"]), " (Topics: ", ", ".join(known["key_topics"]), ")"]), False

    class Fixed:
        def attach(self, requests):
            return requests.drop("system", "prompt").join(
                spark.createDataFrame(list(enumerate(responses)), "doc_id int, response string"), "doc_id")

    pages = spark.range(len(responses)).select(F.col("id").cast("int").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(opening).alias("content"))
    got = {r.doc_id: (None if r.failed else r.rollup, r.failed)
           for r in summaries.rollup_summaries(summaries.page_summaries(pages, Fixed())).collect()}
    wrong = [(responses[i], got[i], expected(r)) for i, r in enumerate(responses) if got[i] != expected(r)]
    assert not wrong, wrong[:3]
    assert sum(failed for _, failed in got.values()) > 20


def test_sections(spark):
    rnd = random.Random(5)
    numbers = [1, 2, 3, 5, None, "4"]
    responses = []
    for _ in range(400):
        def subsection():
            return some(rnd, {"title": ["s", "t", None], "page_start": numbers, "page_end": numbers, "level": [2, 3]}) | ({"title": "u"} if rnd.random() < 0.8 else {})

        def section():
            out = some(rnd, {"page_start": numbers, "page_end": numbers, "level": [1, 4]}) | ({"title": "T"} if rnd.random() < 0.95 else {})
            if rnd.random() < 0.5:
                out["subsections"] = rnd.choice([None, "", "x", {}, 1, []]) if rnd.random() < 0.15 else [subsection() for _ in range(rnd.randrange(3))]
            return out

        sections = rnd.choice(SCALARS + ODD) if rnd.random() < 0.1 else [section() for _ in range(rnd.randrange(4))]
        responses.append(noisy(rnd, json.dumps({"sections": sections} if rnd.random() < 0.95 else {})))

    def number(v):
        return int(v) if isinstance(v, (int, str)) else None

    def listed(v):
        """The items of a value that may stand for a list of objects with titles, else None."""
        if v in ("", {}) and type(v) is not bool:
            return []
        return v if type(v) is list and all(type(x) is dict and "title" in x for x in v) else None

    def row(path, item, level, pages):
        known = {"level": level, "page_start": pages[0], "page_end": pages[1], **item}
        return (path, number(known["level"]), item["title"], number(known["page_start"]), number(known["page_end"]))

    def expected(response):
        data = span(response, "{", "}")
        sections = None if data is None else listed(data["sections"]) if "sections" in data else []
        if sections is None:
            return None
        nodes = [([], 0, "d", 1, 9)]
        for i, s in enumerate(sections, 1):
            below = listed(s["subsections"]) if "subsections" in s else []
            if below is None or below and not {"page_start", "page_end"} <= set(s):
                return None
            nodes.append(row([i], s, 1, (1, 9)))
            nodes += [row([i, j], t, 2, (s["page_start"], s["page_end"])) for j, t in enumerate(below, 1)]
        return nodes

    df = spark.createDataFrame([(i, "d", 9, r) for i, r in enumerate(responses)], "doc_id int, title string, page_count int, response string")
    decoded = tree.decode_toc(df).cache()
    usable = {r.doc_id for r in decoded.where("sections IS NOT NULL").collect()}
    got = {}
    for r in tree.toc_nodes(decoded).orderBy("doc_id", "path").collect():
        got.setdefault(r.doc_id, []).append((list(r.path), r.level, r.title, r.page_start, r.page_end))
    wrong = [(responses[i], got.get(i), expected(r)) for i, r in enumerate(responses)
             if (got.get(i) and sorted(got[i])) != (expected(r) and sorted(expected(r)))]
    assert not wrong, wrong[:3]
    assert usable == set(got) and len(usable) > 50
