"""Phrase collocations over a prefix-free parse.

Every text is cut where its own content says so: a window of four tokens (words,
and one token where a piece ends) whose hash is divisible by ``modulus`` ends a
chunk and begins the next, so neighbouring chunks overlap by that window. No
chunk is the beginning of another. Equal passages give equal chunks; the distinct
chunks of a language and their frequencies in the parse are the dictionary, and
all that follows counts inside the distinct chunks, weighted by frequency. A
phrase of up to five words lies whole in the chunk where it begins; one that
begins in the trailing overlap belongs to the next chunk.

Phrases are counted level by level, as one can be frequent only if its parts are:
words, pairs of frequent words, then longer phrases of frequent pairs. These
counts go by hash; what was frequent is passed on as a bitmap of fixed size, which
lets some others through where it is full but keeps nothing back. With its count,
a hash keeps a sum of checks of its phrases and one place where it occurs. A last
pass reads the words of each frequent hash there, and only there: one row a phrase,
not one for every task that meets it. If a sum of checks does not fit the words
found, several phrases share the hash, and all are counted by their words instead.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliotree.functions.durable import stored
from foliotree.llm.batches import small_batches

LONGEST, LEAST, TOP, MODULUS = 5, 100, 2000, 64
OVERLAP = LONGEST - 1
#: Bits of the bitmap of frequent phrases, whatever the corpus: 8 MB.
BITMAP_BITS = 1 << 26
#: Checks of phrases have 31 bits, their sums are compared modulo a prime; places are told apart by multiples of an odd number.
CHECKS, CHECK_SHIFT, PLACES = (1 << 31) - 1, np.uint64(33), 2_654_435_761
#: Tokens that a task cuts at once; a task combines the phrases of chunks of four times as many bytes before it hands their counts on.
BUFFER = 1 << 20
MAX_WORDS = 200_000
#: Candidates of a language in one sort, and the most parts that they are ranked in.
RANK_ROWS, RANK_PARTS = 200_000, 1000

PIECE_END = b"\n"
_UPPER, _ENDS = bytes(range(65, 91)), b".,;:!?\x0b\x0c\r"
#: A-Z lower-cased, all that ends a piece made one byte, tabs made spaces.
_PLAIN = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + PIECE_END * len(_ENDS) + b" ")
_U = np.uint64
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


class _WordHashes(dict):
    """64-bit hashes of words; the end of a piece is 0. Bounded, what does not fit is hashed again."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        number = 0 if word == PIECE_END else xxhash.xxh3_64_intdigest(word) | 1
        if len(self) < MAX_WORDS:
            self[word] = number
        return number


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(33))


def tokens(text: bytes | None) -> list[bytes]:
    """The words, A-Z lower-cased, with one token between pieces; nothing for a text without words."""
    plain = (text or b"").translate(_PLAIN).replace(PIECE_END, b" \n ")
    for several, one in ((b"  ", b" "), (b"\n \n", PIECE_END)):
        while several in plain:  # a run halves each time
            plain = plain.replace(several, one)
    plain = plain.strip(b" \n")
    return plain.split(b" ") if plain else []


def _chunks(padded: list[bytes], hashes: np.ndarray, sizes: list[int], modulus: int) -> list[list[bytes]]:
    """The chunks of texts of so many tokens, which lie one after another in ``padded``, each with ``OVERLAP`` ends of pieces after it."""
    value = np.zeros(max(len(padded) - OVERLAP, 0), _U)
    for k in range(OVERLAP):
        value = _mixed(value + hashes[k : len(value) + k] * _MIX[k])
    at = np.flatnonzero(value % _U(modulus) == 0)
    size = np.array(sizes, np.int64)
    ends = np.cumsum(size + OVERLAP) - OVERLAP
    begins = ends - size
    inner, out = at.tolist(), []
    for begin, end, first, last in zip(begins.tolist(), ends.tolist(), np.searchsorted(at, begins, "right").tolist(), np.searchsorted(at, ends).tolist()):
        cuts = [begin, *inner[first:last], end]
        out.append([b" ".join(padded[a : b + OVERLAP]) for a, b in zip(cuts, cuts[1:]) if a < b])
    return out


def parse(found: list[bytes], hashes: np.ndarray, modulus: int = MODULUS) -> list[bytes]:
    """The chunks of a text's tokens, as tokens joined by one space; the last one ends in ends of pieces."""
    # The text and the ends of pieces that close it; the hash of those is 0.
    return _chunks(found + [PIECE_END] * OVERLAP, np.append(hashes, np.zeros(OVERLAP, _U)), [len(found)], modulus)[0]


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", modulus: int = MODULUS) -> DataFrame:
    """``lang, chunk, words, n, place``: every distinct chunk of a language, the words that begin in it, its frequency and the task that made it."""
    small_batches(docs.sparkSession)

    def run(batches):
        hashed = _WordHashes()

        def cut(langs, padded, sizes):
            coded = pa.array(padded, pa.binary()).dictionary_encode()
            numbers = np.fromiter(map(hashed.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), _U, len(coded.dictionary))
            own = _chunks(padded, numbers[coded.indices.to_numpy()], sizes, modulus)
            return ((lang, chunk) for lang, found in zip(langs, own) for chunk in found)

        for batch in batches:
            seen: Counter = Counter()
            langs, padded, sizes = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = tokens(text)
                langs.append(lang)
                padded += found
                padded += [PIECE_END] * OVERLAP
                sizes.append(len(found))
                if len(padded) > BUFFER:
                    seen.update(cut(langs, padded, sizes))
                    langs, padded, sizes = [], [], []
            seen.update(cut(langs, padded, sizes))
            words = []
            for _, chunk in seen:
                own = chunk.rsplit(b" ", OVERLAP)[0]
                words.append(own.count(b" ") + 1 - own.count(PIECE_END))
            yield pa.RecordBatch.from_arrays([
                pa.array([x for x, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.binary()),
                pa.array(words, pa.int64()), pa.array(seen.values(), pa.int64()),
            ], names=["lang", "chunk", "words", "n"])

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(run, "lang string, chunk binary, words long, n long").groupBy("lang", "chunk", "words").agg(F.sum("n").alias("n"))
    return counted.withColumn("place", F.spark_partition_id())


class Bitmap:
    """Which hashes were frequent. Whatever is put in is found; what is not may be."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def empty(cls, size: int = BITMAP_BITS) -> Bitmap:
        return cls(np.zeros(size // 64, np.int64))

    def with_keys(self, keys: DataFrame, column: str = "h") -> Bitmap:
        """With all keys. The driver gets at most one number per 64 bits, however many keys there are."""
        slots = len(self.bits)
        folded = keys.select(F.pmod(F.col(column), F.lit(slots)).alias("slot"), F.shiftrightunsigned(F.col(column), 58).cast("int").alias("bit"))
        rows = folded.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
        bits = self.bits.copy()
        bits[rows.column("slot").to_numpy()] |= rows.column("bits").to_numpy()
        return Bitmap(bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        number = hashes.view(np.int64)
        return (self.bits[number % len(self.bits)] >> (hashes >> _U(58)).astype(np.int64)) & 1 == 1


class Spread:
    """The tokens of many chunks one after another, with the hash of the phrase of each length that begins at each."""

    def __init__(self, chunks: pa.Table):
        import xxhash

        split = pc.split_pattern(chunks.column("chunk").combine_chunks(), " ")
        langs = chunks.column("lang").combine_chunks().dictionary_encode()
        lengths = np.diff(split.offsets.to_numpy())
        coded = split.values.dictionary_encode()
        #: The tokens as they are, and as numbers below ``distinct``.
        self.tokens, self.codes, self.distinct = split.values, coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        self.rows = np.repeat(np.arange(len(lengths)), lengths)
        self.weight = chunks.column("n").to_numpy()[self.rows]
        self.place = chunks.column("place").to_numpy()
        self.langs, self.lang_codes = langs.dictionary, langs.indices.to_numpy()
        self.own = np.arange(len(self.codes)) < (np.cumsum(lengths) - OVERLAP)[self.rows]
        digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        numbers = np.frombuffer(digests, _U).reshape(-1, 2)
        ends = coded.dictionary.index(PIECE_END).as_py()
        numbers = np.where((np.arange(len(numbers)) == ends)[:, None], _U(0), numbers | _U(1))
        self.word, self.check = numbers[self.codes, 0], numbers[self.codes, 1]
        self.lang = _mixed(np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs.to_pylist()], _U))[self.lang_codes][self.rows]

    def levels(self, last: int):
        """``(words, hash, check, whole)`` of each length up to ``last``; ``whole``: whether a phrase that begins here meets no end of a piece.

        ``check`` comes of other bits of the words than ``hash``; its last ``CHECK_SHIFT`` bits do not count.
        """
        size, none = len(self.word), np.zeros(last, _U)
        further, check = np.append(self.word, none), np.append(self.check, none)
        inside = further != 0
        hashes, checks, whole = _mixed(self.word + self.lang), self.check + self.lang, inside[:size]
        yield 1, hashes, checks, whole
        for k in range(1, last):
            hashes = _mixed(hashes * _MIX[0] + further[k : size + k])
            checks, whole = checks * _MIX[3] + check[k : size + k], whole & inside[k : size + k]
            yield k + 1, hashes, checks, whole

    def texts(self, at: np.ndarray, words: int) -> tuple[pa.Array, pa.Array]:
        """Language and words of the phrases of so many words that begin at ``at``."""
        found = self.tokens.take(pa.array((at[:, None] + np.arange(words)).ravel())).to_pylist()
        joined = pa.array([b" ".join(found[k : k + words]) for k in range(0, len(found), words)], pa.binary())
        return self.langs.take(pa.array(self.lang_codes[self.rows[at]])), joined.cast(pa.string())


def _spreads(batches):
    """Chunks gathered to parts of about ``BUFFER`` bytes and more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("chunk").nbytes
        if size > 4 * BUFFER:
            yield Spread(pa.Table.from_batches(held))
            held, size = [], 0
    if sum(map(len, held)):
        yield Spread(pa.Table.from_batches(held))


def _folded(x: np.ndarray) -> np.ndarray:
    """Smaller numbers that are the same modulo ``CHECKS``."""
    return (x & _U(CHECKS)) + (x >> _U(31))


def _after(mask: np.ndarray) -> np.ndarray:
    """The value at the next place."""
    return np.append(mask[1:], False)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where in it each group begins."""
    order = np.argsort(keys)
    ordered = keys[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(keys)])


def _frequent(chunks: DataFrame, frequent: Bitmap, first: int, last: int, least: int) -> DataFrame:
    """``h, n, checks, place`` of the phrases of ``first`` to ``last`` words that occur ``least`` times by their hash.

    Only those are counted whose parts of ``first - 1`` words the bitmap knows.
    ``checks`` is the sum of the phrases' checks over all occurrences, modulo ``CHECKS``;
    ``place`` is one place in whose chunks the phrase occurs.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(frequent.bits)

    def run(batches):
        known = Bitmap(shared.value)
        for spread in _spreads(batches):
            found, likely = [], None
            for words, hashes, checks, whole in spread.levels(last):
                if words < first:
                    likely = whole & known.has(hashes) if words == first - 1 else None
                    continue
                likely = whole if likely is None else likely & _after(likely) & whole
                here = np.flatnonzero(likely & spread.own)
                found.append((hashes[here], checks[here] >> CHECK_SHIFT, here))
            hashes, checks, here = map(np.concatenate, zip(*found))
            if not len(hashes):
                continue
            order, begin = _groups(hashes)
            weight, one = spread.weight[here[order]], order[begin]
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes[one].view(np.int64)), pa.array(np.add.reduceat(weight, begin)),
                pa.array(_folded(np.add.reduceat(_folded(weight.view(_U) * checks[order]), begin)).view(np.int64)),
                pa.array(spread.place[spread.rows[here[one]]]),
            ], names=["h", "n", "checks", "place"])

    counts = chunks.select("lang", "chunk", "n", "place").mapInArrow(run, "h long, n long, checks long, place int")
    return counts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("checks").alias("checks"), F.min("place").alias("place")).where(F.col("n") >= least)


def _placed(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    return hashes ^ (place.astype(_U) * _U(PLACES))


def _texts(chunks: DataFrame, frequent: Bitmap, placed: Bitmap) -> DataFrame:
    """``h, check, lang, phrase, words``: the frequent phrases by their words, each from its own place only.

    A bitmap may let others through, and a place's tasks or buffers may each hand a phrase on.
    """
    spark = chunks.sparkSession.sparkContext
    shared, shared_placed = spark.broadcast(frequent.bits), spark.broadcast(placed.bits)

    def run(batches):
        known, own_place = Bitmap(shared.value), Bitmap(shared_placed.value)
        for spread in _spreads(batches):
            for words, hashes, checks, whole in spread.levels(LONGEST):
                here = np.flatnonzero(spread.own & whole if words <= 2 else spread.own & whole & likely & _after(likely))
                here = here[known.has(hashes[here])]
                if words == 2:  # longer ones consist of known pairs
                    likely = np.zeros_like(whole)
                    likely[np.flatnonzero(whole)] = known.has(hashes[whole])
                elif words > 2:
                    likely = likely & _after(likely)
                here = here[own_place.has(_placed(hashes[here], spread.place[spread.rows[here]]))]
                order, begin = _groups(hashes[here])
                at = here[order[begin]]
                lang, phrase = spread.texts(at, words)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes[at].view(np.int64)), pa.array((checks[at] >> CHECK_SHIFT).astype(np.int64)), lang, phrase, pa.array(np.full(len(at), words, np.int32)),
                ], names=["h", "check", "lang", "phrase", "words"])

    return chunks.select("lang", "chunk", "n", "place").mapInArrow(run, "h long, check long, lang string, phrase string, words int")


def _exact(chunks: DataFrame, frequent: Bitmap, least: int) -> DataFrame:
    """``lang, phrase, words, f`` of the phrases in ``frequent`` that occur ``least`` times, counted by their words and not by hashes."""
    shared = chunks.sparkSession.sparkContext.broadcast(frequent.bits)

    def run(batches):
        known = Bitmap(shared.value)
        for spread in _spreads(batches):
            codes = spread.lang_codes[spread.rows].astype(np.int64)
            for words, hashes, _, whole in spread.levels(LONGEST):
                further = spread.codes if words == 1 else np.append(spread.codes[words - 1 :], np.zeros(words - 1, np.int64))
                codes = np.unique(codes * spread.distinct + further, return_inverse=True)[1]
                here = np.flatnonzero(spread.own & whole & known.has(hashes))
                order, begin = _groups(codes[here])
                if not len(order):
                    continue
                lang, phrase = spread.texts(here[order[begin]], words)
                yield pa.RecordBatch.from_arrays([
                    lang, phrase, pa.array(np.full(len(begin), words, np.int32)), pa.array(np.add.reduceat(spread.weight[here[order]], begin)),
                ], names=["lang", "phrase", "words", "n"])

    counts = chunks.select("lang", "chunk", "n", "place").mapInArrow(run, "lang string, phrase string, words int, n long")
    return counts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def frequent_phrases(chunks: DataFrame, least: int = LEAST, bits: int = BITMAP_BITS) -> DataFrame:
    """``lang, phrase, words, f`` of the phrases of two to ``LONGEST`` words that occur ``least`` times, and of the words in them.

    ``chunks`` is a stored dictionary.
    """
    none = Bitmap.empty(bits)
    single = stored(_frequent(chunks, none, 1, 1, least), "words")
    pairs = stored(_frequent(chunks, none.with_keys(single), 2, 2, least), "pairs")
    longer = stored(_frequent(chunks, none.with_keys(pairs), 3, LONGEST, least), "longer")
    counts = single.unionByName(pairs).unionByName(longer)
    known = none.with_keys(counts)
    placed = counts.select(F.col("h").bitwiseXOR(F.col("place").cast("long") * F.lit(PLACES)).alias("h"))
    # A hash that several phrases share has other checks than so many times those of one.
    one = F.expr(f"pmod(pmod(n, {CHECKS}L) * check, {CHECKS}L) = pmod(checks, {CHECKS}L)")
    found = counts.join(_texts(chunks, known, none.with_keys(placed)).distinct(), "h").where(one)
    found = stored(found.select("lang", "phrase", "words", F.col("n").alias("f")), "found")
    if found.count() != counts.count():
        found = stored(_exact(chunks, known, least), "found")
    inside = found.where("words = 2").select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    return found.where("words >= 2").unionByName(found.where("words = 1").join(inside, ["lang", "phrase"], "left_semi").select(found.columns))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, n, l, r, score`` of the phrases of two words or more, by their lowest-scoring cut.

    ``phrases`` is ``lang, phrase, words, f``, ``totals`` is ``lang, n``. Products are decimals of 38 digits.
    """
    part = lambda begin, length: F.array_join(F.slice(F.split("phrase", " "), begin, length), " ")
    cuts = phrases.where("words >= 2").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "cut",
                       part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    count = lambda name, of: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(of))
    parts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast({wide('a')} * {wide('n')} as decimal(34, 0)) * 1000bd) div ({wide('l')} * {wide('r')})")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low")
    return parts.groupBy("lang", "phrase", "words", "a", "n").agg(lowest).select(
        "lang", "phrase", "words", "a", "n", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))


def without_parts(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """``candidates`` without those that lie in a longer one which occurs ``percent`` per cent as often or more."""
    words = F.split("phrase", " ")
    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda at: F.array_join(F.slice(words, at, k), " ")))))
    longer = candidates.where("words >= 3").select("lang", places.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(longer, ["lang", "phrase"], "left")
    return kept.where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")


def ranked(kept: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their ``rank``: by score, then count, both descending, then phrase by its bytes.

    A language is ranked in parts of about ``RANK_ROWS`` first, of which only the first ``top`` meet.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sizes = kept.groupBy("lang").agg(F.least(F.ceil(F.count("*") / RANK_ROWS), F.lit(RANK_PARTS)).alias("parts"))
    dealt = kept.join(sizes, "lang").withColumn("part", F.pmod(F.xxhash64("phrase"), F.col("parts")))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rank: Column = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).drop("part", "parts", "words")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
                 modulus: int = MODULUS, bits: int = BITMAP_BITS) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``n`` counts all words of a language, ``a`` the phrase, ``l`` and ``r`` the parts
    of its lowest-scoring cut (ties to the shortest first part), ``score`` is
    ``floor(1000 * a * n / (l * r))``. Phrases of two to five words that occur
    ``least`` times count, without those that lie in a longer one of the same
    frequency. Null texts are empty, a null language is ``und``. Texts without
    words, and no rows, give no rows; repeated rows count again. Other columns are
    not read.
    """
    chunks = stored(dictionary(docs, text_col, lang_col, modulus), "chunks")
    totals = stored(chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n")), "totals")
    phrases = stored(frequent_phrases(chunks, least, bits), "phrases")
    candidates = stored(scored(phrases, totals), "candidates")
    return ranked(without_parts(candidates), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
