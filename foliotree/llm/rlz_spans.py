"""Repeated passages across documents by relative Lempel-Ziv parsing.

A window of 50 words that also starts in a document with a smaller id is to go.
The corpus is its own reference, in blocks that are dealt by content so that two
documents with a common window meet: a window is named by the smallest hash of
its ten-word shingles (its anchor), neighbouring windows with one anchor are one
passage of at most 90 words, and only anchors that two documents share matter.
Equal passages are one, held by its smallest id.

A block holds all passages of its anchors and is indexed by the order of their
suffixes (prefix doubling; the ranks kept on the way give the common length of
any two places). The longest match of a place among smaller ids is with the
nearest such suffix above or below it in that order. Every passage is factored
greedily against its block: the longest match from where the last factor ended.
A factor of 50 words or more is a duplicate span. A window that no factor
contains can still be in the reference; it then holds exactly one factor's
boundary, so the windows around boundaries whose two factors are long enough
together are looked up, too.

An anchor with more than ``HOT`` different passages would be a block without a
bound. Its windows are compared by a 128-bit key of their words instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliotree.functions.durable import stored
from foliotree.llm.batches import small_batches
from foliotree.llm.key_filter import flagged, folded

WINDOW, SHINGLE = 50, 10
#: Different passages of an anchor up to which it is factored inside a block, and passages of a block.
HOT, BLOCK = 1024, 4096
MAX_WORDS = 200_000

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=_U)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        number = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_WORDS:
            self[word] = number
        return number


def anchors(words: list[bytes], hashed: dict, window: int = WINDOW, shingle: int = SHINGLE) -> np.ndarray:
    """The smallest hash of the shingles of every window, in order; nothing for fewer words than a window has."""
    count = len(words) - window + 1
    if count < 1:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(hashed.__getitem__, words), _U, len(words))
    size = len(words) - shingle + 1
    total, factor = np.zeros(size, _U), _ODD[0]
    with np.errstate(over="ignore"):
        for k in range(shingle):
            total += hashes[k : size + k] * factor
            factor = factor * _ODD[1] + _ODD[2] | _U(1)
        total = (total ^ (total >> _U(29))) * _ODD[0]
        total ^= total >> _U(32)
    least, width, span = total, 1, window - shingle + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: count], least[span - width :][:count]).view(np.int64)


def passages(found: np.ndarray, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(first, last)`` window of the passages: neighbouring windows with one anchor, at most as many as hold one shingle."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    most = window - shingle + 1
    begin = np.concatenate([[0], np.flatnonzero(found[1:] != found[:-1]) + 1])
    long = np.diff(np.append(begin, len(found)))
    parts = -(-long // most)
    first = np.repeat(begin, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    return first, np.append(first[1:], len(found)) - 1


class ReferenceBlock:
    """Passages in the order of their suffixes, each with the smallest id that holds it."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        words = b" ".join(texts).split(b" ")
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        self.lengths = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
        # Behind every passage stands a number of its own, so no match goes beyond one.
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        size = int((self.lengths + 1).sum())
        text = np.empty(size, np.int64)
        closing = self.starts + self.lengths
        inside = np.ones(size, bool)
        inside[closing] = False
        text[closing] = len(number) + np.arange(len(texts))
        text[inside] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.ranks = [text]
        width = 1
        while width <= int(self.lengths.max()):
            rank = self.ranks[-1]
            code = rank * (size + len(number) + 1)
            code[:-width] += rank[width:] + 1
            self.ranks.append(np.unique(code, return_inverse=True)[1])
            width *= 2
        self.owner = np.repeat(ids, self.lengths + 1)
        self._neighbours()

    def _neighbours(self) -> None:
        """For every place the nearest suffixes above and below it that belong to a smaller id, -1 if there is none."""
        order = np.argsort(self.ranks[-1], kind="stable")
        owners, places, size = self.owner[order].tolist(), order.tolist(), len(order)
        found = []
        for steps in (range(size), range(size - 1, -1, -1)):
            nearest, stack = [-1] * size, []
            for k in steps:
                mine = owners[k]
                while stack and owners[stack[-1]] >= mine:
                    stack.pop()
                if stack:
                    nearest[places[k]] = places[stack[-1]]
                stack.append(k)
            found.append(np.array(nearest, np.int64))
        self.above, self.below = found

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two different places have in common; 0 where ``b`` is -1."""
        out = np.zeros(len(a), np.int64)
        there = b >= 0
        a, b = a[there], b[there]
        same = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            same += (rank[a + same] == rank[b + same]).astype(np.int64) << level
        out[there] = same
        return out

    def match(self, places: np.ndarray) -> np.ndarray:
        """The longest match of each place in a passage of a smaller id."""
        return np.maximum(self.common(places, self.above[places]), self.common(places, self.below[places]))

    def spans(self, window: int = WINDOW) -> list[tuple[int, int, int]]:
        """``(passage, first, last)`` window of all windows that a smaller id holds, from the factors of all passages."""
        known = np.zeros(len(self.owner) + 1, np.int64)  # +1 where a range of windows begins, -1 behind its end
        at, before = self.starts.copy(), np.full(len(self.starts), -1)
        end = self.starts + self.lengths
        while len(at):
            factor = self.match(at)
            long = factor >= window
            np.add.at(known, at[long], 1)
            np.add.at(known, at[long] + factor[long] - window + 1, -1)
            low = np.maximum(before + 1, at - window + 1)
            many = np.minimum(at + factor - window, at - 1) - low + 1
            many[(before < 0) | (many < 0)] = 0
            around = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            around = around[self.match(around) >= window]
            np.add.at(known, around, 1)
            np.add.at(known, around + 1, -1)
            further = at + np.maximum(factor, 1)
            open_ = further < end
            at, before, end = further[open_], at[open_], end[open_]
        held = np.concatenate([[False], np.cumsum(known[:-1]) > 0, [False]])
        turns = np.flatnonzero(held[1:] != held[:-1])
        first, last = turns[::2], turns[1::2] - 1
        passage = np.searchsorted(self.starts, first, "right") - 1
        return list(zip(passage.tolist(), (first - self.starts[passage]).tolist(), (last - self.starts[passage]).tolist()))


def _digest(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _words(batch, at: int) -> list[list[bytes]]:
    return [(t or b"").split() for t in batch.column(at).cast(pa.binary()).to_pylist()]


def _with_anchors(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """``doc_id, digest, anchors`` (different ones) of the rows that have an id and a window."""
    def run(batches):
        hashed = _WordHashes()
        for batch in batches:
            found = [np.unique(anchors(w, hashed, window, shingle)) for w in _words(batch, 2)]
            lengths = [len(x) for x in found]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *lengths]).astype(np.int32), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "digest", "anchors"])
            yield out.filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    return docs.where("doc_id IS NOT NULL").select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, anchors array<bigint>")


def _passages(texts: DataFrame, window: int, shingle: int) -> DataFrame:
    """From ``doc_id, digest, text, anchors``: the passages of those anchors, with the place of their first word."""
    def run(batches):
        import xxhash

        hashed = _WordHashes()
        for batch in batches:
            out: list[tuple] = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _words(batch, 2), batch.column(3).to_pylist())
            for doc_id, digest, words, wanted in rows:
                found = anchors(words, hashed, window, shingle)
                first, last = passages(found, window, shingle)
                here = np.flatnonzero(np.isin(found[first], wanted))
                for a, b, anchor in zip(first[here].tolist(), last[here].tolist(), found[first[here]].tolist()):
                    text = b" ".join(words[a : b + window])
                    out.append((doc_id, digest, a, b - a + window, anchor, xxhash.xxh3_128_digest(text), text))
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["doc_id", "digest", "at", "n", "anchor", "passage", "content"])

    return texts.select("doc_id", "digest", "text", "anchors").mapInArrow(
        run, "doc_id long, digest binary, at long, n long, anchor long, passage binary, content binary")


def _factored(contents: DataFrame, blocks: int, window: int) -> DataFrame:
    """``passage, first, last``: the windows of a passage that a smaller id than the passage's has."""
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("passage").to_pylist()
        block = ReferenceBlock(table.column("content").to_pylist(), table.column("least").to_numpy())
        found = block.spans(window)
        return pa.table({"passage": pa.array([keys[p] for p, _, _ in found], pa.binary()),
                         "first": pa.array([a for _, a, _ in found], pa.int64()), "last": pa.array([b for _, _, b in found], pa.int64())})

    dealt = contents.select(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block"), "passage", "content", "least")
    return dealt.groupBy("block").applyInArrow(run, "passage binary, first long, last long")


def _by_windows(contents: DataFrame, window: int) -> DataFrame:
    """The same, by comparing windows one by one: as many rows as windows, none of them holds words."""
    def run(batches):
        import xxhash

        for batch in batches:
            out = []
            for key, least, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = text.split(b" ")
                out += [(xxhash.xxh3_128_digest(b" ".join(words[k : k + window])), key, least, k) for k in range(len(words) - window + 1)]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.binary(), pa.int64(), pa.int64()])],
                                             names=["w", "passage", "least", "first"])

    windows = stored(contents.select("passage", "least", "content").mapInArrow(run, "w binary, passage binary, least long, first long"), "windows")
    holders = windows.groupBy("w").agg(F.min("least").alias("holder"))
    return windows.join(holders, "w").where("holder < least").select("passage", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``doc_id, digest, spans`` of the rows of ``docs (doc_id, digest, text)`` that have words to remove.

    ``spans`` is an array of (first word, word behind the last), which may overlap.
    """
    found = stored(_with_anchors(docs, window, shingle), "anchors")
    single = found.select("doc_id", "digest", F.explode("anchors").alias("anchor"))
    shared = stored(single.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "shared")
    wanted = stored(single.join(shared, "anchor").groupBy("doc_id", "digest").agg(F.collect_set("anchor").alias("anchors")), "wanted")
    texts = flagged(docs, folded(wanted, F.col("doc_id"), F.col("digest")), "__open", F.col("doc_id"), F.col("digest")).where("__open")
    pieces = stored(_passages(texts.join(wanted, ["doc_id", "digest"]), window, shingle), "passages")

    contents = stored(pieces.groupBy("anchor", "passage").agg(F.min("doc_id").alias("least"), F.first("content").alias("content")), "contents")
    sizes = stored(contents.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    told = flagged(contents, folded(sizes, F.col("anchor")), "__several", F.col("anchor")).where("__several")
    # An anchor that the filter takes for a hot one goes that way with all its passages, so the answer is the same.
    told = flagged(told, folded(sizes.where(F.col("n") > hot), F.col("anchor")), "__hot", F.col("anchor"))
    total = sizes.where(F.col("n") <= hot).agg(F.sum("n")).first()[0] or 0
    inside = _factored(told.where("NOT __hot"), max(1, -(-total // block)), window).unionByName(_by_windows(told.where("__hot"), window))

    ranges = inside.groupBy("passage").agg(F.collect_set(F.struct("first", "last")).alias("inside"))
    verdicts = contents.select("passage", "least").join(ranges, "passage", "left")
    span = lambda a, b: F.struct(a.alias("begin"), b.alias("end"))
    of_piece = F.when(F.col("doc_id") > F.col("least"), F.array(span(F.col("at"), F.col("at") + F.col("n")))).otherwise(
        F.transform("inside", lambda r: span(F.col("at") + r["first"], F.col("at") + r["last"] + window)))
    removed = pieces.select("doc_id", "digest", "at", "n", "passage").join(stored(verdicts, "verdicts"), "passage").select(
        "doc_id", "digest", F.explode(of_piece).alias("span"))
    return removed.groupBy("doc_id", "digest").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    shingle: int = SHINGLE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, spans, kept``.

    A word is removed if a window of ``window`` words covers it that also starts in
    a document with a smaller id, judged on the words as they came. ``spans`` are
    the removed ranges, ``(begin, end)`` in words, and ``kept`` the other words
    joined by one space. Null and empty texts have no words. A row without an id is
    neither smaller nor larger than any: it stays whole and removes nothing. Rows
    that share an id are one document's: none of them removes words of another. No
    rows give no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(text_col).cast("string")).alias("digest"), F.col(text_col).cast("string").alias("text"))
    spans = stored(repeated_spans(read, window, shingle, hot, block), "spans")
    told = flagged(read, folded(spans, F.col("doc_id"), F.col("digest")), "__hit", F.col("doc_id"), F.col("digest"))
    hit = told.where("__hit").join(spans, ["doc_id", "digest"], "left").select("doc_id", "text", "spans")
    whole = told.where("NOT __hit").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def run(batches):
        for batch in batches:
            sizes, gone, ranges, kept = [], [], [], []
            for words, given in zip(_words(batch, 1), batch.column(2).to_pylist()):
                sizes.append(len(words))
                left = words
                merged: list[dict] = []
                if given:
                    change = np.zeros(len(words) + 2, np.int64)
                    np.add.at(change, [s["begin"] + 1 for s in given], 1)
                    np.add.at(change, [s["end"] + 1 for s in given], -1)
                    covered = np.cumsum(change) > 0  # the word k is at k + 1
                    turns = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
                    merged = [{"begin": a, "end": b} for a, b in zip(turns[::2], turns[1::2])]
                    left = [words[k] for k in np.flatnonzero(~covered[1:-1])]
                gone.append(len(words) - len(left))
                ranges.append(merged)
                kept.append(b" ".join(left))
            span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(ranges, pa.list_(span)),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return hit.unionByName(whole).mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<begin:bigint,end:bigint>>, kept string")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
