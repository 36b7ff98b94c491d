"""Main text of web pages by consensus of the pages of a host.

1. On every page each container is scored by the text blocks below it, and the
   page votes for the generalised tag-class path of its best one.
2. Spark counts the votes per host; paths with a fifth of a host's votes win.
3. Every page is extracted again from the winning path with most text on it, or,
   where none of them has a fair share of its text, from its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliotree.functions.durable import stored
from foliotree.llm.batches import small_batches

_words = lambda text: frozenset(text.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title noscript iframe noembed noframes xmp")
BLOCKS = _words(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul"
)
CELLS = _words("td th br")  # they separate words, not blocks
CONTAINERS = _words("article main section div td body blockquote center table")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
# Never part of an article.
DROPPED_TAGS = _words(
    "nav footer aside script style noscript template iframe object embed svg math canvas audio video map button select textarea "
    "input dialog menu head title xmp noembed noframes search"
)
DROPPED_ROLES = _words("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip")
# Words of class and id attributes of what is around an article.
DROPPED_NAMES = _words(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promotion promoted banner sidebar menu menus "
    "nav navbar navigation breadcrumb breadcrumbs crumbs footer masthead cookie cookies consent gdpr notice notices notification notifications "
    "alert alerts popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist disqus reply replies "
    "respond discussion share sharing social related recommended recommendations widget widgets toolbar pagination pager skip hidden "
    "copyright legal disclaimer"
)
# What may hold a whole page, so that an article or main inside is one all the same.
SOFT_TAGS = _words("nav footer aside header")
SOFT_ROLES = _words("navigation banner contentinfo complementary search form menu toolbar")
# Names are a vote: what they or a form enclose is dropped if it has at most such a share of the page's text.
SMALL, MOST = 0.2, 0.5
# A share of text or of links that is small, and the mean length of blocks that are prose.
FEW, PROSE = 0.2, 40
# A class says by these that something is or isn't beside it.
_STATE = re.compile("(?:has|no|not|with|without|is)[-_]", re.I)
COMMENT_NAMES = _words("comment comments commentlist reply replies disqus")
GOOD_NAMES = _words("article content entry post story main body text page")
# A start tag of one of these ends an open element of those.
CLOSES = {
    "li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"),
    "option": _words("option"), "tbody": _words("tr td th thead tbody"), "tfoot": _words("tr td th tbody thead"), "body": _words("head"),
}
SCOPES = _words("table ul ol dl div section article main body td th blockquote nav aside header footer form figure")
HARD, SOFT = 2, 1  # dropped for good, and but for an article inside
MAX_DEPTH = 2000  # of containers with a path of their own; what is deeper belongs to the last of them
DOUBT = 0.2  # what a container that a name speaks against counts beside one with a good name

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)|<[!?][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_TOLD = re.compile("class|id|role|hidden|style", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


# Dropped with all that is in them, without looking inside.
WHOLLY_DROPPED = _words("nav footer aside svg math select button dialog menu object")
_PAIRS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])|<(?:article|main)(?=[\s/>])", re.I) for tag in WHOLLY_DROPPED}


def _beyond(source: str, tag: str, position: int) -> int:
    """Where an element that was opened before ``position`` ends; 0 if it isn't closed or an article starts in it."""
    depth = 1
    for m in _PAIRS[tag].finditer(source, position):
        if m[1] is None:
            return 0
        depth += -1 if m[1] else 1
        if not depth:
            return source.find(">", m.end()) + 1
    return 0


def _unclosed(source: str, tag: str, position: int) -> bool:
    """Whether an element that was opened before ``position`` never ends."""
    depth = 1
    for m in _PAIRS[tag].finditer(source, position):
        if m[1] is not None:
            depth += -1 if m[1] else 1
            if not depth:
                return False
    return True


def _names(*values: str) -> set[str]:
    return {w.lower() for v in values for w in _NAME.findall(v)}


class _Element:
    __slots__ = ("tag", "path", "dropped", "container", "inside", "heading_only", "region")

    def __init__(self, tag, path, dropped, container, inside, heading_only, region):
        self.tag, self.path, self.dropped, self.container, self.inside, self.heading_only, self.region = tag, path, dropped, container, inside, heading_only, region


class Page:
    """Text blocks of a page with the containers that they stand in, in page order."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []  # text, characters in links, containers from the outermost
        self.paths: list[str] = ["html>body"]  # of each container
        self.parents: list[int] = [-1]
        self.good: list[bool] = [False]
        self.doubtful: list[bool] = [False]  # whether it stands in an element that a name speaks against
        # Of each element that its name or a form speaks against: the one around it, the share up to which it goes, whether an article is in it.
        self._around: list[int] = [-1]
        self._most: list[float] = [-1.0]
        self._holds: list[bool] = [True]
        self._comment: list[bool] = [False]
        self._pieces: list[tuple[list[tuple[int, str, bool]], int]] = []  # of a block: region, text, whether in a link; its container
        self._parse(source)
        self._judge()

    def _open(self, tag: str, raw: str, above: _Element, deep: bool) -> _Element:
        attributes = {}
        if len(raw) > 1 and _TOLD.search(raw):
            for m in _ATTRIBUTE.finditer(raw):
                attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        classes = attributes.get("class", "")
        names = _names(classes, attributes.get("id", "")) if classes or "id" in attributes else set()
        whole = tag in ("html", "body", "main")
        role = attributes.get("role", "").lower()
        hidden = not whole and ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
                                or "display:none" in attributes.get("style", "").replace(" ", "").lower())
        hard = hidden or (tag in DROPPED_TAGS and tag not in SOFT_TAGS) or (not whole and role in DROPPED_ROLES - SOFT_ROLES)
        soft = tag in SOFT_TAGS - {"header"} or (not whole and role in SOFT_ROLES)
        dropped, heading_only = (HARD if hard else above.dropped or (SOFT if soft else 0)), above.heading_only
        if above.dropped == SOFT and tag in ("article", "main") and not above.inside and not hard:
            dropped, heading_only = 0, False
        if not dropped and not whole and (tag == "header" or ("header" in names and tag in ("div", "section"))):
            # The head of an article has its title; that of the page does not.
            dropped, heading_only = 0 if above.inside else SOFT, True
        region = above.region
        if not dropped and not whole:
            told = names if not _STATE.search(classes) else _names(*(c for c in classes.split() if not _STATE.match(c)), attributes.get("id", ""))
            comment = bool(told & COMMENT_NAMES)
            if tag in HEADINGS or tag == "p" or tag == "article" or (tag == "section" and above.inside):
                against = comment and tag in ("article", "section")
            else:
                against = bool(told & DROPPED_NAMES) or tag == "form"
            if against:
                self._around.append(region)
                self._most.append(MOST if comment or tag == "form" else SMALL)
                self._holds.append(False)
                self._comment.append(comment)
                region = len(self._around) - 1
        if not dropped and tag in ("article", "main") and region == above.region:
            at = region
            while at > 0 and not self._holds[at]:
                self._holds[at] = True
                at = self._around[at]
        inside = above.inside or (tag in ("article", "main") and not dropped)
        path = above.path
        container = above.container
        if tag in CONTAINERS and tag != "body" and not deep:
            token = ".".join([tag, *sorted({re.sub(r"[0-9]+", "N", c) for c in classes.split()})])
            path = f"{above.path}>{token}"
            if not dropped:
                self.paths.append(path)
                self.parents.append(container)
                self.good.append(tag in ("article", "main") or attributes.get("role", "").lower() == "main" or bool(names & GOOD_NAMES))
                self.doubtful.append(region > 0)
                container = len(self.paths) - 1
        return _Element(tag, path, dropped, container, inside, heading_only, region)

    def _judge(self) -> None:
        """Blocks of all text but that of comments and of the small or link-heavy elements that a name or a form speaks against.

        Comments go however long they are, unless an article is in them or there is no prose beside them.
        """
        sizes, linked = [0] * len(self._around), [0] * len(self._around)
        for pieces, _ in self._pieces:
            for region, piece, link in pieces:
                n = len(piece.strip())
                sizes[region] += n
                linked[region] += n * link
        for at in range(len(sizes) - 1, 0, -1):  # what is inside comes later
            around = max(self._around[at], 0)
            sizes[around] += sizes[at]
            linked[around] += linked[at]
        remarks, within = 0, [False] * len(sizes)
        for at in range(1, len(sizes)):
            around = max(self._around[at], 0)
            told = self._comment[at] and not self._holds[at]
            within[at] = within[around] or told
            remarks += (sizes[at] - linked[at]) * (told and not within[around])
        beside = sizes[0] - linked[0] - remarks >= PROSE
        gone = [False] * len(sizes)
        for at in range(1, len(sizes)):
            n = sizes[at]
            gone[at] = gone[max(self._around[at], 0)] or (beside and self._comment[at] and not self._holds[at]) or (
                not self._holds[at] and n <= MOST * sizes[0] and (n <= self._most[at] * sizes[0] or 2 * linked[at] > n))
        for pieces, container in self._pieces:
            block = " ".join(html.unescape("".join([piece for region, piece, _ in pieces if not gone[region]])).split())
            if block:
                chain, at = [], container
                while at >= 0:
                    chain.append(at)
                    at = self.parents[at]
                self.blocks.append((block, sum([len(piece) for region, piece, link in pieces if link and not gone[region]]), tuple(reversed(chain))))
        self._pieces.clear()

    def _parse(self, source: str) -> None:
        stack = [_Element("", "html>body", 0, 0, False, False, 0)]
        text: list[tuple[int, str, bool]] = []
        links, menu = 0, False
        opened: Counter = Counter()  # open elements by tag

        def end_block() -> None:
            nonlocal text
            if text:
                self._pieces.append((text, stack[-1].container))
                text = []

        def add(piece: str) -> None:
            top = stack[-1]
            if not top.dropped and (not top.heading_only or any(e.tag in HEADINGS for e in stack[-4:])):
                text.append((top.region, piece, links > 0))

        def close_to(at: int) -> None:
            nonlocal links
            for e in stack[at:]:
                opened[e.tag] -= 1
            if at == len(stack) - 1:
                if stack[at].tag in BLOCKS:
                    end_block()
                elif stack[at].tag == "a":
                    links = max(0, links - 1)
                stack.pop()
                return
            if any(e.tag in BLOCKS for e in stack[at:]):
                end_block()
            links = max(0, links - sum(e.tag == "a" for e in stack[at:]))
            del stack[at:]

        def find(tags, scope) -> int:
            if not any(opened[t] for t in tags):
                return 0
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in tags:
                    return at
                if stack[at].tag in scope:
                    break
            return 0

        position, end = 0, len(source)
        while position < end:
            m = _TOKEN.search(source, position)
            if m is None:
                add(source[position:])
                break
            if m.start() > position:
                add(source[position : m.start()])
            position = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                at = find((tag,), ())
                if at:
                    close_to(at)
                elif tag in ("p", "br"):
                    end_block()
                continue
            if tag in CELLS:
                text.append((stack[-1].region, " ", False)) if text else None
            if tag in BLOCKS:
                end_block()
                at = find(("p",), SCOPES)
                if at:
                    close_to(at)
            if tag in CLOSES:
                at = find(CLOSES[tag], SCOPES - CLOSES[tag])
                if at:
                    close_to(at)
            if tag in VOID:
                continue
            if tag in RAW:
                stop = _RAW_END[tag].search(source, position)
                at = stop.start() if stop else end
                close = source.find(">", at)
                position = end if stop is None or close < 0 else close + 1
                continue
            if tag in WHOLLY_DROPPED:
                beyond = _beyond(source, tag, position)
                if beyond:
                    position = beyond
                    continue
                if tag in SOFT_TAGS and 2 * position < end and _unclosed(source, tag, position):
                    menu = True  # its end was forgotten: the list that comes first is its own, not the rest of the page
                    continue
            if m[0].endswith("/>") and tag not in BLOCKS and tag not in ("a", "b", "i", "span", "em", "strong"):
                continue
            stack.append(self._open(tag, m[3], stack[-1], len(stack) >= MAX_DEPTH))
            opened[tag] += 1
            links += tag == "a"
            if menu and tag not in ("a", "span", "b", "i", "em", "strong"):
                if tag in ("ul", "ol", "dl"):
                    stack[-1].dropped = max(stack[-1].dropped, SOFT)
                menu = False
        end_block()

    def best(self) -> tuple[int, float]:
        """The container that scores highest: text without links counts fully for the nearest one, less and less above."""
        def scored(doubt: float) -> list[float]:
            scores = [0.0] * len(self.paths)
            for text, linked, chain in self.blocks:
                value = max(0.0, len(text) - 2.0 * linked) * (doubt if self.doubtful[chain[-1]] else 1.0)
                for at in reversed(chain):
                    scores[at] += value
                    value *= 0.6
            return [x * 1.5 if good else x for x, good in zip(scores, self.good)]

        scores = scored(1.0)
        # Where a good name stands apart from what names speak against, that hardly counts.
        if any(self.doubtful) and any(good and not self.doubtful[at] and scores[at] >= PROSE for at, good in enumerate(self.good)):
            scores = scored(DOUBT)
        top = max(range(len(scores)), key=lambda at: (scores[at], -at))
        return top, scores[top]

    def text_of(self, wanted: set[int]) -> str:
        return "\n\n".join(text for text, _, chain in self.blocks if not wanted.isdisjoint(chain))

    def raised(self, wanted: set[int]) -> set[int]:
        """``wanted`` or what it stands in, as long as that adds prose: long blocks with few links. Never the whole body, never beyond an article."""
        while True:
            up = {self.parents[at] for at in wanted}
            if min(up) <= 0 or any(self.paths[at].rsplit(">", 1)[1].split(".")[0] in ("article", "main") for at in wanted):
                return wanted
            rest = [(len(text), linked) for text, linked, chain in self.blocks if not up.isdisjoint(chain) and wanted.isdisjoint(chain)]
            size = sum(n for n, _ in rest)
            if size < PROSE * max(1, len(rest)) or sum(n for _, n in rest) > FEW * size:
                return wanted
            wanted = up

    def extract(self, winners: list[str] | None, known: list[str] | None = None) -> tuple[str, str | None]:
        """(text, path used): of the winning path with most unlinked text here, or of the page's best container.

        The latter where no winner is on the page, and where the winner has less
        than ``FEW`` of its text, unless only this page speaks for it: its path is
        not among the ``known`` ones, it has no name of an article's, and the
        winner's path ends in a class.
        """
        unlinked = lambda wanted: sum([max(0, len(text) - linked) for text, linked, chain in self.blocks if not wanted.isdisjoint(chain)])
        top, score = self.best()
        found = []
        for place, path in enumerate(winners or ()):
            wanted = {at for at, own in enumerate(self.paths) if own == path}
            if wanted and self.text_of(wanted):
                found.append((-unlinked(wanted), place, wanted))
        if found:
            size, place, wanted = min(found, key=lambda f: f[:2])
            told = self.good[top] or self.paths[top] in (known or ()) or "." not in winners[place].rsplit(">", 1)[1]
            if not (told and score > 0 and -size < FEW * unlinked({top})):
                wanted = self.raised(wanted)
                return self.text_of(wanted), self.paths[min(wanted)]
        if score <= 0:
            return self.text_of({0}), None
        wanted = self.raised({top})
        return self.text_of(wanted), self.paths[min(wanted)]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, score``: one vote a page; pages without text have none."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source or "")
                top, score = page.best()
                if score > 0:
                    hosts.append(host)
                    paths.append(page.paths[top])
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())],
                                             names=["host", "path", "score"])

    return pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "host string, path string, score double")


def winning_paths(votes: DataFrame, share: float = 0.2) -> DataFrame:
    """``host, winners, known``: the paths with at least ``share`` of the host's votes, most votes first, ties by path.

    ``known`` are those with at least two votes and a hundredth of the host's.
    Votes are counted before the shuffle, so a host with most of the pages is a few rows; at most ``1 / share`` paths win.
    The host '' is no host: its pages speak for themselves only.
    """
    counts = votes.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    totals = counts.groupBy("host").agg(F.sum("n").alias("total"))
    wins, heard = F.col("n") >= F.col("total") * share, (F.col("n") >= 2) & (F.col("n") * 100 >= F.col("total"))
    ordered = lambda of: F.sort_array(F.collect_list(F.when(of, F.struct((-F.col("n")).alias("n"), F.col("path").alias("path")))))
    told = counts.join(totals, "host").where(wins | heard).groupBy("host").agg(ordered(wins).alias("w"), ordered(heard).alias("k"))
    return told.select("host", F.col("w.path").alias("winners"), F.col("k.path").alias("known"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.2) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, path``.

    ``text`` is the article's blocks joined by an empty line, '' for a null or
    empty page; ``path`` is the path that it was taken from. A null or malformed
    URL has no host, and its page is extracted by itself. Repeated rows vote and are extracted each for
    itself. Other columns of ``pages`` are not read. The winners are a stored table that
    Spark broadcasts if it is small and joins by shuffle otherwise.
    """
    small_batches(pages.sparkSession)
    winners = stored(winning_paths(page_votes(pages, url_col, html_col), share), "winners")
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))

    def run(batches):
        for batch in batches:
            texts, used = [], []
            for source, paths, known in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                text, path = Page(source or "").extract(paths, known)
                texts.append(text)
                used.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())],
                                             names=["page_id", "url", "text", "n_chars", "path"])

    return read.join(winners, "host", "left").select("page_id", "url", "html", "winners", "known").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, path string")
