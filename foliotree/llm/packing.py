"""Packing token sequences: bounded-space online best-fit.

Every task keeps a fixed number of open windows. A piece goes into the fullest
window that still takes it (best fit). Where none takes it, the fullest window
is emitted; if it would be padded by more than ``cut_gap`` tokens, the head of
the piece fills it first. The windows that a task has open at its end are
leftovers: their pieces (ids are no longer needed, so these are narrow rows)
are merged by the same rule in tasks of at most ``merge_windows`` windows each.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliotree.functions.durable import stored
from foliotree.llm.batches import small_batches

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Punctuation that ends a token group of its own behind a word of letters.
TAIL = ".,!?;:#$%&*|"
# Entries of a worker's caches; what does not fit is tokenised whenever it is met.
MAX_WORDS, MAX_CORES = 250_000, 500_000

_TOKENIZERS: dict = {}


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit integers, by way of a bounded cache of words.

    The vocabulary drops white space and never looks across it, so a text's ids
    are the ids of its blank-separated words one after another. A word of
    letters and trailing punctuation is the ids of both parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.ends = bytearray(self.encode.get_vocab_size())
        for token, number in self.encode.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.words: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        ids = self.encode.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_cores(self, cores: list[str], out: dict[str, bytes]) -> None:
        for at in range(0, len(cores), 20_000):
            part = cores[at : at + 20_000]
            ids = self.encode.encode(" ".join(part), add_special_tokens=False).ids
            cuts = [k + 1 for k, number in enumerate(ids) if self.ends[number]]
            if len(cuts) != len(part):
                out.update((core, self._whole(core)) for core in part)
                continue
            packed = struct.pack(f"<{len(ids)}I", *ids)
            out.update((core, packed[4 * a : 4 * b]) for core, a, b in zip(part, [0, *cuts], cuts))

    def resolve(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not cached yet."""
        found, split, missing = {}, [], set()
        for word in words:
            core = word.rstrip(TAIL)
            if core and core.isalpha() and "Σ" not in core and (low := core.lower()).isalpha():
                split.append((word, low, word[len(core):]))
                if low not in self.cores:
                    missing.add(low)
            else:
                found[word] = self._whole(word)
        fresh: dict[str, bytes] = {}
        self._encode_cores(list(missing), fresh)
        for word, low, tail in split:
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {"": b""}
                self.tails[tail] = self._whole(tail)
            found[word] = (self.cores.get(low) or fresh[low]) + self.tails[tail]
        for low, ids in fresh.items():
            if len(self.cores) >= MAX_CORES:
                break
            self.cores[low] = ids
        return found

    def batch(self, texts: list[str | None]) -> list[bytes]:
        split = [(text or "").replace("\n", " ").split(" ") for text in texts]
        new = set().union(*split).difference(self.words) if split else set()
        found = self.resolve(new)
        for word, ids in found.items():
            if len(self.words) >= MAX_WORDS:
                break
            if len(word) <= 40:
                self.words[word] = ids
        cached = self.words
        out = []
        for words in split:
            try:
                out.append(b"".join(map(cached.__getitem__, words)))
            except KeyError:
                out.append(b"".join([cached[w] if w in cached else found[w] for w in words]))
        return out


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per vocabulary and worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class OpenWindows:
    """At most ``limit`` open windows of ``capacity`` tokens, kept by the room that they have left."""

    def __init__(self, capacity: int, limit: int, cut_gap: int | None, first_id: int):
        self.capacity, self.limit, self.cut_gap = capacity, limit, cut_gap
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}
        self.opened, self.next_id, self.done = 0, first_id, []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((*piece, self.next_id, offset))
            offset += piece[2]
        self.next_id += 1

    def _put(self, at: int | None, piece: tuple) -> None:
        if at is None:
            room, window = self.capacity, self.opened
            self.opened += 1
            self.held[window] = []
        else:
            room, window = self.rooms.pop(at)
        self.held[window].append(piece)
        if room == piece[2]:
            self._emit(self.held.pop(window))
        else:
            insort(self.rooms, (room - piece[2], window))

    def add(self, doc_id, start: int, length: int, doc_tokens: int, crc) -> None:
        """Place ``length`` tokens of a document from ``start`` on. ``crc(a, b)``: checksum of its tokens a to b."""
        end = start + length
        while start < end:
            rest = end - start
            if self.cut_gap is not None and rest >= self.capacity:
                size = self.capacity
                self._emit([(doc_id, start, size, crc(start, start + size), doc_tokens)])
                start += size
                continue
            at = bisect_left(self.rooms, (rest, -1))
            if at == len(self.rooms):
                at = None
                if len(self.rooms) >= self.limit:
                    room = self.rooms[0][0]
                    if self.cut_gap is not None and room > self.cut_gap:
                        self._put(0, (doc_id, start, room, crc(start, start + room), doc_tokens))
                        start += room
                        continue
                    self._emit(self.held.pop(self.rooms.pop(0)[1]))
            self._put(at, (doc_id, start, rest, crc(start, end), doc_tokens))
            start = end

    def take_done(self) -> list:
        done, self.done = self.done, []
        return done

    def leftovers(self) -> list:
        """The windows still open, as (window, pieces)."""
        out = [(window, self.held.pop(window)) for _, window in self.rooms]
        self.rooms = []
        return out


_FIRST = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _table(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_FIRST)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FIRST)


def _pack_partition(path: str, capacity: int, open_windows: int, cut_gap: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        words, end = tokenizer(path), struct.pack("<I", end_id)
        windows = OpenWindows(capacity, open_windows, cut_gap, TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, found in zip(ids, words.batch(batch.column(1).to_pylist())):
                packed = found + end
                count = len(packed) // 4
                windows.add(doc_id, 0, count, count, lambda a, b, p=packed: zlib.crc32(p[4 * a : 4 * b]))
            yield _table(windows.take_done())
        # Leftover pieces carry a negative sequence id.
        yield _table([(*piece, -1 - window, 0) for window, pieces in windows.leftovers() for piece in pieces])

    return run


def _merge_partition(capacity: int, open_windows: int):
    def run(batches):
        from pyspark import TaskContext

        windows = OpenWindows(capacity, open_windows, None, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            for doc_id, start, length, crc, doc_tokens in zip(*(c.to_pylist() for c in batch.columns)):
                windows.add(doc_id, start, length, doc_tokens, lambda a, b, c=crc: c)
            yield _table(windows.take_done())
        for _, pieces in windows.leftovers():
            windows._emit(pieces)
        yield _table(windows.take_done())

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         open_windows: int = 32, cut_gap: int = 64, end_id: int = 1, merge_windows: int = 4096) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``capacity`` tokens.

    A document is its text's ids and ``end_id``; a null text is empty (one
    token). Each token is in exactly one piece. Columns: ``doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset``; other columns of
    ``docs``, whatever their names, are not read. Repeated rows are packed each
    for itself, a null id is kept, and no rows give no pieces.

    The first pass is stored once, because its leftovers are merged from the
    same run that the other pieces come from; a task that is repeated reads the
    same rows in the same order and packs alike.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = stored(read.mapInArrow(_pack_partition(vocabulary, capacity, open_windows, cut_gap, end_id), PIECES), "packed")
    left = first.where("sequence_id < 0")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // (merge_windows * capacity)))
    merged = (
        left.select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        .repartition(tasks)
        .sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
        .mapInArrow(_merge_partition(capacity, merge_windows), PIECES)
    )
    return first.where("sequence_id >= 0").unionByName(merged)
