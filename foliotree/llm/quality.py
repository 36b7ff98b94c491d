"""Quality classifier from weak labels.

Ten overlapping heuristics look at a text and vote clean, junk or not at all.
Expectation-maximisation over the counts of all vote patterns estimates how
often each one votes which way on either class, without any given labels, and
so the probability of junk behind every pattern. These posterior labels train a linear
scorer on hashed features (four-grams of character classes, repetition), which
scores all texts, those with contradicting or missing votes too.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliotree.llm.batches import small_batches

# Character classes: lower, upper, digit, blank, prose punctuation, '!', '|', other symbols.
LOWER, UPPER, DIGIT, BLANK, PROSE, SHOUT, PIPE, SYMBOL = range(8)
_CLASS = np.full(256, LOWER, np.uint8)
_CLASS[:128] = SYMBOL
for _chars, _kind in ((range(97, 123), LOWER), (range(65, 91), UPPER), (range(48, 58), DIGIT), (b" \t\n\r\x0b\x0c", BLANK), (b".,;:'\"-()?", PROSE),
                      (b"!", SHOUT), (b"|", PIPE)):
    for _c in _chars:
        _CLASS[_c] = _kind
LABELLERS = ("symbols", "endings", "capitals", "shouts", "pipes", "marks", "repeats", "runs", "plain", "sentences")
JUNK, CLEAN, ABSTAIN = 0, 1, 2
# Slots of the hashed four-grams, and levels of each of the two repetition features behind them.
GRAM_SLOTS, LEVELS = 1 << 11, 16
DIMENSIONS = GRAM_SLOTS + 2 * LEVELS
#: Rows that the scorer is trained on, at most twice as many.
TRAIN_ROWS = 3000
#: A text is rejected if junk is at least this likely.
REJECT_AT = 0.5

_SLOT = ((np.arange(1 << 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)  # 11 bits


# Scripts without blanks between words: such a text is read in groups of four characters, as if they were words.
_UNSPACED_BYTES = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef][\x80-\xbf]{2}")
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f]{1,4})")
_WIDE_MARKS = str.maketrans({"\u3002": ". ", "\uff01": "! ", "\uff1f": "? ", "\uff0c": ", ", "\u3001": ", ", "\uff1a": ": ", "\uff1b": "; ", "\u300c": '"',
                             "\u300d": '"', "\uff08": "(", "\uff09": ")", "\u3000": " "})
_BEFORE_MARK = re.compile(r" ([.,!?:;)\"])")
# What ends a sentence before a blank, and elsewhere (danda, Arabic, Armenian and Ethiopic marks, ellipsis).
_ENDS = (b". ", b".\n", b"? ", b"?\n", b"! ", b"!\n", b'." ', b'?" ', b".) ", b"\xe0\xa5\xa4", b"\xe0\xa5\xa5", b"\xd8\x9f", b"\xdb\x94", b"\xd6\x89", b"\xe1\x8d\xa2",
         b"\xe2\x80\xa6")


def spaced(data: bytes) -> bytes:
    """The text with blanks in stretches of scripts that have none; others as they are."""
    if not _UNSPACED_BYTES.search(data):
        return data
    grouped = _UNSPACED.sub(r"\1 ", data.decode("utf-8", "replace").translate(_WIDE_MARKS))
    return _BEFORE_MARK.sub(r"\1", grouped).encode()


def sentence_ends(data: bytes) -> int:
    return sum(map(data.count, _ENDS)) + data.endswith((b".", b"?", b"!"))


def _facts(data: bytes) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    """Character classes, their counts, words, share of words equal to the one before, and to either neighbour."""
    classes = _CLASS[np.frombuffer(data, np.uint8)]
    counts = np.bincount(classes, minlength=8)
    words = data.split()
    n = len(words)
    same = [False, *map(bytes.__eq__, words, words[1:]), False]
    return classes, counts, n, sum(same) / n if n else 0.0, sum(map(bool.__or__, same[1:], same)) / n if n else 0.0


def votes(data: bytes) -> tuple[int, ...]:
    """One vote a labeller. A text without words gets none; texts of few words only those that few words can show.

    Most labellers know one sort of junk and say nothing about other texts; the
    last two also know prose. Each sort of junk is seen by two labellers or more.
    Scripts without blanks are read in groups of characters.
    """
    given, data = data, spaced(data)
    classes, counts, n, repeats, runs = _facts(data)
    if not n:
        return (ABSTAIN,) * len(LABELLERS)
    letters = max(1, counts[LOWER] + counts[UPPER])
    shown = len(data) - counts[BLANK]
    plain = letters + counts[DIGIT] + counts[PROSE]
    varied = counts[UPPER] < max(3, 0.3 * letters) and repeats < 0.2 and runs < 0.35
    # What stands before a blank or the end, and marks that stand between blanks.
    blank = np.concatenate([[True], classes == BLANK, [True]])
    last = classes[blank[2:] & ~blank[1:-1]]
    odd = float((last >= SHOUT).mean())
    lone = blank[:-2] & blank[2:] & ~blank[1:-1]
    marks = int((classes[lone] >= PROSE).sum()) / n
    sentences = sentence_ends(data)
    lines = len(data.split(b"\n"))  # verse and code end in lines
    junk = lambda sign: JUNK if sign else ABSTAIN
    return (
        junk(counts[SYMBOL] > 0.4 * n), junk(odd > 0.3), junk(counts[UPPER] > 0.4 * letters), junk(counts[SHOUT] > 0.3 * n),
        junk(counts[PIPE] > 0.3 * n), junk(marks > 0.2), junk(n >= 8 and repeats > 0.3), junk(n >= 8 and runs > 0.45),
        CLEAN if plain > 0.95 * shown and varied else junk(plain < 0.85 * shown),
        ABSTAIN if n < 30 else CLEAN if n < 40 * sentences and varied else junk(data is given and n > 100 * (sentences + lines - 1)),
    )


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of hashed features, as a vector of at most length one, shorter for few bytes, which say little.

    A text without words has none.
    """
    data = spaced(data)
    classes, _, n, repeats, runs = _facts(data)
    if not n:
        return np.empty(0, np.uint16), np.empty(0, np.float32)
    out = np.zeros(DIMENSIONS)
    if len(classes) >= 4:
        c = classes.astype(np.uint16)
        counts = np.bincount(c[:-3] << 9 | c[1:-2] << 6 | c[2:-1] << 3 | c[3:], minlength=1 << 12)
        seen = np.flatnonzero(counts)
        out[:GRAM_SLOTS] = np.bincount(_SLOT[seen], np.sqrt(counts[seen] / (len(c) - 3)), minlength=GRAM_SLOTS)
    for kind, value in ((0, repeats), (1, runs)):
        out[GRAM_SLOTS + kind * LEVELS + int(min(value, 0.999) * LEVELS)] = 1.0
    slots = np.flatnonzero(out)
    values = out[slots]
    scale = math.sqrt(len(data) / (len(data) + 32.0) / float(values @ values))
    return slots.astype(np.uint16), (values * scale).astype(np.float32)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (posterior of junk per pattern, P(vote | class) [labeller, class, vote], prior of junk).

    Not voting is a third vote. The start takes texts with a vote for junk for
    likely junk, which tells the classes apart.
    """
    post = np.array([0.02, 0.6, 0.95])[np.minimum((patterns == JUNK).sum(1), 2)]
    prior, rates = 0.1, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        before = post
        odds = np.full(len(patterns), math.log(prior / (1 - prior)))
        for j in range(patterns.shape[1]):
            for k, weight in ((JUNK, post * counts), (CLEAN, (1 - post) * counts)):
                rates[j, k] = (np.bincount(patterns[:, j], weight, minlength=3) + 0.05) / (weight.sum() + 0.15)
            odds += np.log(rates[j, JUNK] / rates[j, CLEAN])[patterns[:, j]]
        prior = min(0.9, max(0.01, (post * counts).sum() / max(1.0, counts.sum())))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(post - before).max(initial=0) < 1e-6:
            break
    return post, rates, prior


def fit_scorer(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 300, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Weights, and the bias behind them, of a logistic regression on soft labels, by gradient descent with momentum.

    The bias is the prior's log-odds and stays: a text that says nothing is as likely junk as any.
    """
    bias = np.float32(math.log(prior / (1 - prior)))
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        v = 0.9 * v - rate * (x.T @ ((p - y) / np.float32(len(y))) + decay * w)
        w = w + v
    return np.append(w, bias)


def _bytes(batch, at: int) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def _code(vote: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(vote))


def vote_patterns(texts: DataFrame) -> DataFrame:
    """``pattern`` (votes in base three) of every row of ``id, text``."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_code(votes(t)) for t in _bytes(batch, 1)], pa.int64())], names=["pattern"])

    return texts.mapInArrow(run, "pattern long")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """The scorer's weights, the labellers' rates and the prior.

    Vote patterns are counted over all rows; at most 3 ** 10 counts come to the
    driver. The scorer is trained on a sample of about ``train_rows`` rows by a hash
    of id and text, at most twice as many; if that hits none, as where all rows are
    one, on the first ``train_rows`` rows. Without rows the scorer keeps everything.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = np.array([tuple(r) for r in vote_patterns(texts).groupBy("pattern").count().orderBy("pattern").collect()], np.int64).reshape(-1, 2)
    patterns = found[:, :1] // 3 ** np.arange(len(LABELLERS)) % 3
    post, rates, prior = fit_labellers(patterns, found[:, 1].astype(float))
    total = int(found[:, 1].sum())
    lookup = dict(zip(found[:, 0].tolist(), post.tolist()))
    slots = 1 << 24
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text"), F.lit(1)), F.lit(slots))
    sample = texts.where(drawn < min(slots, slots * train_rows // max(1, total) + 1))

    def run(batches):
        for batch in batches:
            rows = [(lookup.get(_code(votes(t)), prior), *(x.tobytes() for x in features(t))) for t in _bytes(batch, 1)]
            y, slots, values = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.float64()), pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
                                             names=["y", "slots", "values"])

    taken = lambda of, n: of.limit(n).mapInArrow(run, "y double, slots binary, values binary").toArrow()
    rows = taken(sample, 2 * train_rows)
    if total and not rows.num_rows:
        rows = taken(texts, train_rows)
    y = rows["y"].to_numpy().astype(np.float32)
    if not len(y):
        weights = np.zeros(DIMENSIONS + 1, np.float32)
        weights[-1] = -5.0
    else:
        x = np.zeros((len(y), DIMENSIONS), np.float32)
        for i, (slots, values) in enumerate(zip(rows["slots"], rows["values"])):
            x[i, np.frombuffer(slots.as_buffer(), np.uint16)] = np.frombuffer(values.as_buffer(), np.float32)
        weights = fit_scorer(x, y, prior)
    return {"weights": weights, "rates": rates, "prior": prior}


def junk_scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Probability of junk of every text; 0 without words."""
    raw = np.full(len(texts), -np.inf)
    for i, text in enumerate(texts):
        slots, values = features(text)
        if len(slots):
            raw[i] = float(weights[slots] @ values) + float(weights[-1])
    return np.round(1 / (1 + np.exp(-np.clip(raw, -30, 30))), 6) * np.isfinite(raw)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """One row per row: ``doc_id, n_words, junk_votes, clean_votes, junk_score, kept``.

    Null texts are empty. A text without words has no features and no votes;
    nothing speaks against it, so its score is 0 and it is kept. Repeated rows get equal
    results, null ids stay. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    weights = model["weights"]

    def run(batches):
        for batch in batches:
            texts = _bytes(batch, 1)
            cast = [votes(t) for t in texts]
            n = [len(t.split()) for t in texts]
            s = junk_scores(texts, weights)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array([v.count(JUNK) for v in cast], pa.int64()),
                pa.array([v.count(CLEAN) for v in cast], pa.int64()), pa.array(s), pa.array(s < reject_at),
            ], names=["doc_id", "n_words", "junk_votes", "clean_votes", "junk_score", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, junk_votes long, clean_votes long, junk_score double, kept boolean")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns as before.

    The scorer sees the text column only and its answer stays beside the row, so nothing is joined.
    """
    weights = fit(docs, id_col, text_col)["weights"]

    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(junk_scores([t or b"" for t in texts.cast(pa.binary()).to_pylist()], weights) < reject_at)

    return docs.where(F.arrow_udf(clean, "boolean")(F.col(text_col)))
