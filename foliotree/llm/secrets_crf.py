"""Secret scan with a linear-chain conditional random field.

Tokens are tagged as begin of, inside or outside a secret, from their shape,
their neighbours and features of the whole file, and decoded by Viterbi. The
field is trained here, on texts of the corpus into which seeded secrets and
harmless look-alikes are put. Only a token that has a digit, is long or of mixed
case, or stands behind an assignment or a word such as password may be tagged at
all; stretches without such a token are outside in every labelling, so decoding
the windows around them is exact. Patterns of known secrets (the base spans) are always reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliotree.llm.batches import small_batches

# The base patterns, their kinds in order, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

KEYWORDS = frozenset("password passwd pwd pass secret token apikey api key auth bearer credential credentials private access".split())
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]+(?:\.+[A-Za-z0-9_+/-]+)*|[^\sA-Za-z0-9_+/-]")
_DIGIT = re.compile(r"[0-9]")
_LONG = re.compile(r"[A-Za-z0-9_+/=-]{32,}")
_SET = re.compile(r"[:=](?=[\"'\x20]{0,4}[A-Za-z0-9+/_.-]{6})")
_MIXED = re.compile(r"[a-z][A-Z]")
# Words behind which even plain letters may be a secret, and how many tokens behind.
TOLD = ("passw", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "bearer", "credential")
_TOLD = re.compile("|".join(TOLD), re.I | re.A)
_BEHIND = 3
_PART = 1 << 20  # characters that are lower-cased at once
_VOWEL = re.compile("[aeiouyAEIOUYà-ÿ]")
_SIDE = 4  # tokens of a window on either side of a candidate
_REACH = 160  # characters on either side of a hit that are tokenised
OUT, BEGIN, INSIDE = range(3)
#: Texts of the corpus that the field is trained on, at most.
TRAIN_ROWS = 200
TRAIN_WIDTH = 64  # tokens of a training window; longer ones are left out of the training


def says(text: str, words: tuple[str, ...]) -> bool:
    """Whether one of the words, plain lower-case letters, is in the text in either case; part by part, whatever its size."""
    reach = max(map(len, words))
    for at in range(0, max(1, len(text)), _PART):
        low = text[at : at + _PART + reach].lower()
        if any(w in low for w in words):
            return True
    return False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns of known secrets, code points, by start and then kind."""
    out = []
    if says(text, ("passw", "secret", "token", "key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def _entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def _hard(word: str) -> int:
    """The longest run of consonants, digits and marks: words can be spoken, secrets can't."""
    return max(map(len, _VOWEL.split(word)))


def _shape(word: str) -> str:
    if len(word) == 1 and not word.isalnum():
        return word if word in "=:\"'@.,|()+" else "sym"
    lower, upper, digit = any("a" <= c <= "z" for c in word), any("A" <= c <= "Z" for c in word), any("0" <= c <= "9" for c in word)
    other = not word.isalnum()
    kind = ("a" if lower else "") + ("A" if upper else "") + ("0" if digit else "") + ("-" if other else "")
    if kind in ("0", "a0", "A0") and all(c in "0123456789abcdef" or c in "0123456789ABCDEF" for c in word) and len(word) >= 8:
        kind += "x"
    return kind


class _File:
    """Features of a whole text."""

    def __init__(self, text: str):
        digits = sum(map(text.count, "0123456789")) / max(1, len(text))
        self.found = ("file:digits" + str(min(3, int(digits * 50))), "file:set" if "=" in text else "file:noset")


def token_features(words: list[str], file: _File) -> list[list[str]]:
    shapes = [_shape(w) for w in words]
    keyed = [w.lower().replace("_", "").replace("-", "") in KEYWORDS or any(k in w.lower() for k in ("password", "secret", "token", "apikey", "api_key"))
             for w in words]
    out = []
    for i, word in enumerate(words):
        back = shapes[max(0, i - 4) : i]
        assigned = i > 0 and any(s in "=:" for s in back[-2:]) if back else False
        key = any(keyed[max(0, i - 4) : i])
        length = min(8, len(word).bit_length() * 2 + (len(word) >= 20))
        out.append([
            f"s:{shapes[i]}", f"s:{shapes[i]},l:{length}", f"l:{length},e:{int(_entropy(word) * 2)}",
            f"p:{shapes[i - 1] if i else '^'}", f"n:{shapes[i + 1] if i + 1 < len(words) else '$'}",
            f"set:{assigned},key:{key}", f"set:{assigned},s:{shapes[i]}", f"key:{key},l:{length}", f"akia:{word.startswith('AKIA')}",
            f"key:{key},hard:{min(5, _hard(word))}", f"hard:{min(5, _hard(word))},l:{length},s:{shapes[i]}",
            *(f"{f},s:{shapes[i]}" for f in file.found),
        ])
    return out


def may_be_secret(words: list[str]) -> list[bool]:
    """Tokens that may be tagged: of six characters and more, and with a digit, long, of mixed case, or behind an assignment or a telling word."""
    out, told = [], -_BEHIND - 1
    for i, w in enumerate(words):
        ok = len(w) >= 6 and (
            i - told <= _BEHIND or len(w) >= 32 or _DIGIT.search(w) is not None or any(x in ("=", ":") for x in words[max(0, i - 2) : i])
            or (len(w) >= 12 and _MIXED.search(w) is not None))
        out.append(ok)
        if _TOLD.search(w):
            told = i
    return out


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token spans of the stretches around everything that may be a secret."""
    patterns = [_DIGIT, _LONG, _SET, _MIXED, *([_TOLD] if says(text, TOLD) else [])]
    hits = [(m.start(), m.end()) for pattern in patterns for m in pattern.finditer(text)]
    hits.sort()
    stretches: list[list[int]] = []
    for a, b in hits:
        a, b = max(0, a - _REACH), min(len(text), b + _REACH)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    out = []
    for a, b in stretches:
        # Whole words only: a stretch ends at blanks, as far as they may be.
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        spans = [m.span() for m in _TOKEN.finditer(text, a, b)]
        allowed = may_be_secret([text[x:y] for x, y in spans])
        at, n = 0, len(spans)
        while at < n:
            if not allowed[at]:
                at += 1
                continue
            start, end = max(0, at - _SIDE), at
            while end < n and (allowed[end] or any(allowed[end : end + 2 * _SIDE])):
                end += 1
            end = min(n, end + _SIDE)
            out.append(spans[start:end])
            at = end
    return out


class Field:
    """Weights of a linear-chain field over three tags; inside never follows outside."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, words: list[str], file: _File) -> np.ndarray:
        out = np.zeros((len(words), 3))
        for i, found in enumerate(token_features(words, file)):
            known = [self.index[f] for f in found if f in self.index]
            if known:
                out[i] = self.emit[known].sum(0)
        out[~np.array(may_be_secret(words), bool), 1:] = -1e9
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        best, back = scores[0] + np.array([0.0, 0.0, -1e9]), []
        for row in scores[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(0))
            best = step.max(0) + row
        tags = [int(best.argmax())]
        for pointers in reversed(back):
            tags.append(int(pointers[tags[-1]]))
        return tags[::-1]


def tagged_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans that the field tags in the text."""
    out, file = [], None
    for spans in windows(text):
        file = file or _File(text)
        tags = field.viterbi(field.scores([text[a:b] for a, b in spans], file))
        for (a, b), tag in zip(spans, tags):
            if tag == BEGIN:
                out.append([a, b])
            elif tag == INSIDE and out:
                out[-1][1] = b
    return [tuple(x) for x in out]


def _fake(draw: np.random.Generator) -> tuple[str, str, bool]:
    """Text around a made-up value, the value, and whether it is a secret. Look-alikes are mail, numbers, dates and paths."""
    pick = lambda letters, n: "".join(letters[k] for k in draw.integers(0, len(letters), n))
    hexa, alnum, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    n, kind = int(draw.integers(16, 44)), int(draw.integers(0, 20))
    value = (pick(hexa, n), pick(alnum, n), "AKIA" + pick(alnum[26:], 16), pick(alnum, n) + "_" + pick(alnum, 6))[int(draw.integers(0, 4))]
    key = ("password", "passwd", "pwd", "secret", "token", "api_key", "auth_token", "client_secret", "apikey")[int(draw.integers(0, 9))]
    around = (f"{key}={{}}", f'{key} = "{{}}"', f"{key}: {{}}", "{}")[int(draw.integers(0, 4))]
    if kind < 6:
        return around, value, True
    if kind < 9:  # letters only, behind a word that tells
        telling = ("my password is {}", "the password was {}", "bearer {}", "password {}", "token: {}", "secret is {}")[int(draw.integers(0, 6))]
        return telling, pick(alnum[:26] if kind == 6 else alnum[:52], int(draw.integers(9, 24))), True
    if kind < 12:  # a telling word, and then any word
        telling = ("the password is {}", "password {}", "a secret {}", "the token was {}", "secrets of {}")[int(draw.integers(0, 5))]
        return telling, _spoken(draw), False
    phone = f"+{pick(digits, 1)} ({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}"
    upper = alnum[26:52]
    harmless = (f"{pick(alnum[:26], 6)}.{pick(digits, 2)}@mail{pick(digits, 1)}.example.com", pick(digits, 16), phone,
                f"{pick(digits, 2)}.{pick(digits, 3)}.{pick(digits, 2)}.{pick(digits, 3)}", f"20{pick(digits, 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)}",
                f"https://{pick(alnum[:26], 8)}.example.com/{pick(alnum[:26], 6)}/{pick(digits, 4)}",
                f"{('room', 'order', 'flight', 'part', 'model', 'No.')[int(draw.integers(0, 6))]} {pick(upper, int(draw.integers(1, 4)))}{pick(digits, int(draw.integers(4, 9)))}",
                f"{pick(upper, 2)}-{pick(digits, 4)}-{pick(upper, 2)}")[kind - 12]
    return "{}", harmless, False


def _spoken(draw: np.random.Generator) -> str:
    """A made-up word that can be spoken."""
    return "".join("bcdfglmnprst"[int(draw.integers(0, 12))] + "aeiou"[int(draw.integers(0, 5))] for _ in range(int(draw.integers(3, 6)))) + ("", "n", "r", "s")[int(draw.integers(0, 4))]


def training_windows(texts: list[str], seed: int = 7, each: int = 9) -> tuple[list, list]:
    """Feature lists and tags of windows: seeded values are put between words of the texts; what the base patterns find counts too."""
    draw = np.random.Generator(np.random.PCG64(seed))
    found, tags = [], []
    for text in texts or ["the value of this is that"]:
        words = text[:4000].split(" ") or [""]
        marks, parts, length = [], [], 0
        places = sorted(draw.integers(0, len(words), each).tolist())
        for at, word in enumerate(words):
            while places and places[0] == at:
                places.pop(0)
                around, value, secret = _fake(draw)
                before, after = around.split("{}")
                if secret:
                    marks.append((length + len(before), length + len(before) + len(value)))
                parts.append(before + value + after)
                length += len(parts[-1]) + 1
            parts.append(word)
            length += len(word) + 1
        made = " ".join(parts)
        for m in ASSIGN.finditer(made):
            if m.end(2) - m.start(2) >= 6:
                marks.append(m.span(2))
        marks += [m.span() for p in (ACCESS, HEX) for m in p.finditer(made)]
        file = _File(made)
        for spans in windows(made):
            words_here = [made[a:b] for a, b in spans]
            allowed = may_be_secret(words_here)
            own, before = [], None
            for (a, b), ok in zip(spans, allowed):
                mark = next((m for m in marks if m[0] < b and a < m[1]), None) if ok else None
                own.append(OUT if mark is None else INSIDE if mark == before else BEGIN)
                before = mark
            if len(spans) > TRAIN_WIDTH:
                continue
            found.append(token_features(words_here, file))
            tags.append((own, allowed))
    return found, tags


def fit(texts: list[str], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Train by gradient ascent on the log-likelihood; windows are padded to one length, so a round is a few array operations."""
    found, tags = training_windows(texts)
    index: dict[str, int] = {}
    for window in found:
        for token in window:
            for f in token:
                index.setdefault(f, len(index))
    width = max(map(len, found))
    n, per = len(found), max(len(t) for w in found for t in w)
    ids = np.full((n, width, per), len(index), np.int64)
    gold = np.zeros((n, width), np.int64)
    mask, allowed = np.zeros((n, width), bool), np.zeros((n, width), bool)
    for i, (window, (own, ok)) in enumerate(zip(found, tags)):
        for t, token in enumerate(window):
            ids[i, t, : len(token)] = [index[f] for f in token]
        gold[i, : len(own)], mask[i, : len(own)], allowed[i, : len(own)] = own, True, ok
    emit, move = np.zeros((len(index) + 1, 3)), np.zeros((3, 3))
    barred = np.zeros((3, 3))
    barred[OUT, INSIDE] = -1e9
    fixed = np.where(allowed[:, :, None] | (np.arange(3) == 0), 0.0, -1e9)
    fixed[:, 0, INSIDE] = -1e9
    one = np.eye(3)[gold] * mask[:, :, None]
    gold_moves = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    squares_e, squares_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    total = mask.sum()

    def log_sum(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        s, m = emit[ids].sum(2) + fixed, move + barred
        ahead, behind = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        ahead[:, 0] = s[:, 0]
        for t in range(1, width):
            step = log_sum(ahead[:, t - 1, :, None] + m, 1) + s[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = log_sum(m[None] + (s[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        z = log_sum(ahead[:, -1], 1)
        p = np.exp(np.clip(ahead + behind - z[:, None, None], -60, 0)) * mask[:, :, None]
        pair = ahead[:, :-1, :, None] + m + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]
        moves = (np.exp(np.clip(pair, -60, 0)) * mask[:, 1:, None, None]).sum((0, 1))
        slope = np.zeros_like(emit)
        np.add.at(slope, ids.reshape(-1), np.repeat((one - p).reshape(-1, 3), per, 0))
        slope, turn = slope / total - decay * emit, (gold_moves - moves) / total - decay * move
        slope[-1] = 0
        squares_e += slope**2
        squares_m += turn**2
        emit += rate * slope / np.sqrt(squares_e)
        move += rate * turn / np.sqrt(squares_m)
    return Field(index, emit, move + barred)


def sample_texts(docs: DataFrame, text_col: str, id_col: str, rows: int) -> list[str]:
    """At most ``rows`` texts to train on, by a hash of the id; heads of 4,000 characters are enough to put values into."""
    total = docs.count()
    slots = 1 << 24
    chosen = docs.where(
        F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(2)), F.lit(slots)) <= min(slots, 3 * slots * rows // max(1, total))
    ).where(F.col(text_col).isNotNull()).select(F.substring(text_col, 1, 4000).alias("t"), F.xxhash64(F.col(id_col).cast("string"), F.lit(2)).alias("h"))
    return [r[0] for r in chosen.orderBy("h", "t").limit(rows).collect()]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, field: Field | None = None) -> DataFrame:
    """One row per row: ``doc_id`` and ``spans``, an array of ``kind, start, end`` by start, then kind.

    Base spans may overlap each other; spans of the field that touch none of
    them follow as kind ``crf``. A null text is empty and has no spans; repeated
    rows get equal spans; a null id stays. Other columns are not read. The field is trained
    on at most ``train_rows`` texts of ``docs`` (none: on made-up ones).
    """
    small_batches(docs.sparkSession)
    field = field or fit(sample_texts(docs, text_col, id_col, train_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for batch in batches:
            spans = []
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else []
                taken = sorted((a, b) for a, _, b in found)
                for a, b in tagged_spans(text, field) if text else ():
                    if not any(x < b and a < y for x, y in taken):
                        found.append((a, 3, b))
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, schema.field("spans").type)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, of the rows of :func:`scan`."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        count("crf").alias("n_crf"),
    )
