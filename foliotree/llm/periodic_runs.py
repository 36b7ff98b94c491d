"""Periodic runs in the words of a document, by suffix trees.

A run is a stretch of words that repeats itself with some period and cannot be
made longer. Two suffix trees, of the words and of their reversal, are built
online (Ukkonen). Walking round a tree visits its leaves in the order of their
suffixes; the least depth that the walk touches between two leaves is the depth
of their lowest common ancestor, and a table of minima over powers of two answers
it for any two leaves in constant time: the longest common extension of two
places, to the right by one tree and to the left by the other.

Every run holds a Lyndon root: the longest Lyndon word that starts at some place
under the order of the words or under its reverse. Both are read off the order
of the leaves, so there are two candidates a place, and each is extended in both
directions.

Trees are made of the stretches that can hold a run at all. In a run of at least
four periods and six words each three consecutive words occur three times or
more; places where they don't in the whole document are in no run and end one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliotree.llm.batches import small_batches

LEAST_WORDS, PERIODS = 6, 4

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class SuffixTree:
    """Of numbers from 1 on; 0 ends the text. Node 0 is the root, the nodes are numbered as they are made."""

    def __init__(self, text: list[int]):
        self.text = [*text, 0]
        self.symbols = max(text, default=0) + 1
        self.first, self.last = [0], [0]  # the edge to a node is text[first:last]
        self.edges: dict[int, int] = {}
        self._build()

    def _node(self, first: int, last: int) -> int:
        self.first.append(first)
        self.last.append(last)
        return len(self.first) - 1

    def _build(self) -> None:
        text, symbols, edges, first, last = self.text, self.symbols, self.edges, self.first, self.last
        size = len(text)
        suffix_link = {0: 0}
        at, edge, depth, pending = 0, 0, 0, 0
        for place, symbol in enumerate(text):
            pending += 1
            made = 0
            while pending:
                if not depth:
                    edge = place
                key = at * symbols + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = self._node(place, size)
                    if made:
                        suffix_link[made] = at
                    made = 0
                else:
                    span = min(last[child], place + 1) - first[child]
                    if depth >= span:
                        at, edge, depth = child, edge + span, depth - span
                        continue
                    if text[first[child] + depth] == symbol:
                        depth += 1
                        if made:
                            suffix_link[made] = at
                        break
                    middle = self._node(first[child], first[child] + depth)
                    edges[key] = middle
                    edges[middle * symbols + symbol] = self._node(place, size)
                    first[child] += depth
                    edges[middle * symbols + text[first[child]]] = child
                    if made:
                        suffix_link[made] = middle
                    made = middle
                pending -= 1
                if at:
                    at = suffix_link.get(at, 0)
                elif depth:
                    depth -= 1
                    edge = place - pending + 1

    def tour(self, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of each suffix its place among the leaves, and the depth of the lowest common ancestor of each leaf and the one before.

        Leaves come in the order of the suffixes, with ``reverse`` under the reversed
        order of the symbols; the end of the text is the least symbol in both.
        """
        symbols, size = self.symbols, len(self.text)
        children: dict[int, list[int]] = {}
        # The child that is visited first is pushed last.
        for key in sorted(self.edges, key=(lambda k: (k % symbols) or symbols) if reverse else (lambda k: -(k % symbols))):
            children.setdefault(key // symbols, []).append(self.edges[key])
        first, last = self.first, self.last
        places, depths = [0] * size, [0] * size
        stack, lowest, seen = [(0, 0, 0)], size, 0
        while stack:
            node, above, depth = stack.pop()
            lowest = min(lowest, above)
            below = children.get(node)
            if below is None:
                places[size - depth] = seen
                depths[seen] = lowest
                seen, lowest = seen + 1, size
            else:
                stack += [(child, depth, depth + last[child] - first[child]) for child in below]
        return np.array(places), np.array(depths, np.int32)


class Extensions:
    """Longest common extensions to the right of pairs of places, each in constant time."""

    def __init__(self, places: np.ndarray, depths: np.ndarray):
        self.places, self.minima = places, [depths]
        width = 1
        while 2 * width <= len(depths):
            half = self.minima[-1]
            self.minima.append(np.minimum(half[:-width], half[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.places[a], self.places[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            here = level == k
            table = self.minima[k]
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(k))])
        return out


def lyndon_ends(places: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word ends that starts at each place: at the next place with a smaller suffix."""
    size = len(places) - 1  # the last suffix is the end of the text
    order, ends, open_places = places.tolist(), [0] * size, [size]
    for at in range(size - 1, -1, -1):
        mine = order[at]
        while order[open_places[-1]] > mine:
            open_places.pop()
        ends[at] = open_places[-1]
        open_places.append(at)
    return np.array(ends, np.int64)


def tree_runs(numbers: list[int], least: int = LEAST_WORDS, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``least`` words and ``periods`` periods or more, by start and period."""
    size = len(numbers)
    if size < max(2, least):
        return []
    tree = SuffixTree(numbers)
    upward = tree.tour()
    to_right = Extensions(*upward)
    to_left = Extensions(*SuffixTree(numbers[::-1]).tour())
    found = []
    for places in (upward[0], tree.tour(reverse=True)[0]):
        begin, end = np.arange(size), lyndon_ends(places)
        period = end - begin
        right = to_right(begin, end)  # the end of the text extends nothing
        left = np.zeros(size, np.int64)
        left[1:] = to_left(size - begin[1:], size - end[1:])
        length = left + period + right
        run = length >= np.maximum(least, periods * period)
        found.append(np.stack([begin - left, period, length], axis=1)[run])
    return [(s, n, p) for s, p, n in np.unique(np.concatenate(found), axis=0).tolist()]


def stretches(numbers: np.ndarray) -> list[tuple[int, int]]:
    """``(from, to)`` of the parts where each three consecutive numbers occur at least three times in all of ``numbers``."""
    if len(numbers) < LEAST_WORDS:
        return []
    _, pairs = np.unique(numbers[:-1].astype(np.int64) * (int(numbers.max()) + 1) + numbers[1:], return_inverse=True)
    _, threes, counts = np.unique(pairs[:-1].astype(np.int64) * (int(numbers.max()) + 1) + numbers[2:], return_inverse=True, return_counts=True)
    often = np.concatenate([[False], counts[threes] >= 3, [False]])
    turns = np.flatnonzero(often[1:] != often[:-1])
    return [(a, b + 2) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()) if b + 2 - a >= LEAST_WORDS]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a document, by start and period."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out = []
    for a, b in stretches(numbers):
        _, dense = np.unique(numbers[a:b], return_inverse=True)
        out += [(a + start, length, period) for start, length, period in tree_runs((dense + 1).tolist())]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only the first period (what another run drops of it goes, too)."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        start, length, period = np.array(runs).T
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs`` (by start and period) and the ``collapsed`` text.

    Words are what ASCII white space separates, compared as they are. Null and
    empty texts have no words and no run, and collapse to the empty text. Repeated
    rows each get their row, null ids are kept, no rows give no rows, other columns
    are not read. ``rewrite`` may change the words of a document beforehand; it is
    called in the tasks. A task holds one batch of texts and one stretch's trees.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if rewrite:
                    words = rewrite(doc_id, words)
                runs = word_runs(words)
                out.append((len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed(words, runs)))
            sizes, runs, texts = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Number, longest run (ties: smallest start, then period) and digests of what :func:`find_runs` returns."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In a tenth of the ids, by their checksum, the words from some place on repeat with a period; a null id changes nothing."""
    import zlib

    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
