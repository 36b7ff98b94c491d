"""Personal data by candidate gradient boosting, in built-in expressions.

Generators of high recall propose overlapping spans (anything around an at
sign, chains of digits with and without blanks). Boosted trees judge a proposal
by its format and context, and become one SQL expression. They are fitted on
made-up values, personal ones of many formats and harmless look-alikes, which
are put between words of a bounded sample of the texts; the corpus's own
proposals have no labels. A threshold calibrated on other made-up values selects
what is added to the spans of the strict patterns, which are always reported.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, functions as F

# The kinds in order and their patterns. Possessive repeats and the look-behind match the same
# spans as plain ones (what follows a repeat is never in its class) in time proportional to the text.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "around_at": r"[\p{L}0-9._%+-]{1,64}+@[\p{L}0-9-]{1,63}+(?:\.[\p{L}0-9-]{1,63}+)*+",
    "digit_chain": r"[+(]?[0-9](?:[\x20().,/:-]{0,3}[0-9])++",
    "digit_word": r"[+(]?[0-9]++(?:[().,/:-]{1,2}[0-9]++)*+",
}
EXTRA = "extra"
LEAST_DIGITS = 7  # of a proposal without an at sign
BLOCK = 256  # hits whose offsets are summed up one after another
SPAN = "array<struct<start:int,end:int,hit:string>>"
FEATURES = ("generator", "digits", "length", "kinds", "plus", "parens", "luhn", "octets", "at", "left", "right", "groups", "lead", "tail", "dots")
#: Trees, their depth, the step, the least share of true ones in each band of scores that is selected, and the least weight of a leaf.
TREES, DEPTH, RATE, PRECISION, LEAF = 24, 4, 0.4, 0.95, 4.0
#: Weight of a band of scores.
BAND = 25.0
#: Made-up values that are fitted on, as many that the threshold is calibrated on, and texts whose first words stand around them.
SEEDED, SAMPLE_TEXTS, SAMPLE_CHARS = 4000, 100, 300


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    # A string is split into its characters between them, not at its end.
    characters = F.split(F.reverse(digits), "(?!^)(?!$)")
    return F.aggregate(F.transform(characters, value), F.lit(0), lambda s, v: s + v) % 10 == 0


def octets(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: p.try_cast("double") <= 255)


def valid(kind: str, hit: Column) -> Column:
    """What a match must hold beside its pattern."""
    if kind == "ip":
        return octets(hit)
    if kind == "card":
        n = F.length(digits_of(hit))
        return F.when((n >= 16) & (n <= 19), luhn(digits_of(hit))).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(hit)).between(8, 15)
    return F.lit(True)


def with_spans(df: DataFrame, text: str, patterns: dict[str, str], guards: dict[str, Column]) -> DataFrame:
    """Add ``<name>``: start, end (code points, end exclusive) and text of all matches of each pattern.

    A text is cut at the matches, and the lengths of gaps and matches are summed
    up, in blocks, so that a text of very many matches takes time in proportion.
    ``guards`` say cheaply that a text may match at all.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__h_{k}": F.when(guards[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    df = df.withColumns({f"__g_{k}": F.when(F.size(f"__h_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()})
    df = df.withColumns({
        f"__s_{k}": F.zip_with(F.slice(f"__g_{k}", F.lit(1), F.size(f"__h_{k}")), f"__h_{k}",
                               lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("long"), h.alias("hit")))
        for k in patterns
    })

    def total(steps: Column, first: Column) -> Column:
        """Running sums of the steps, the first one in front."""
        return F.aggregate(steps, F.array(first), lambda done, s: F.concat(done, F.array(F.element_at(done, -1) + s)))

    def blocks(k: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(f"__h_{k}") - 1) / BLOCK).cast("int")),
                           lambda b: F.slice(f"__s_{k}", b * BLOCK + 1, F.lit(BLOCK)))

    df = df.withColumns({f"__b_{k}": F.when(F.size(f"__h_{k}") > 0, blocks(k)) for k in patterns})
    df = df.withColumns({
        f"__o_{k}": total(F.transform(f"__b_{k}", lambda b: F.aggregate(b, F.lit(0), lambda n, s: n + s["gap"] + s["long"])), F.lit(0))
        for k in patterns
    })

    def spans(k: str) -> Column:
        def of_block(b: Column, i: Column) -> Column:
            ends = total(F.transform(b, lambda s: s["gap"] + s["long"]), F.element_at(f"__o_{k}", i + 1))
            return F.zip_with(b, F.slice(ends, F.lit(2), F.lit(BLOCK)), lambda s, e: F.struct(
                (e - s["long"]).alias("start"), e.alias("end"), s["hit"].alias("hit")))
        return F.coalesce(F.flatten(F.transform(f"__b_{k}", of_block)), F.array().cast(SPAN))

    df = df.withColumns({k: spans(k) for k in patterns})
    return df.drop(*[f"__{c}_{k}" for c in "hgsbo" for k in patterns])


def proposals(generator: int, spans: Column, text: Column) -> Column:
    """Proposals of one generator with their features, small whole numbers."""
    def level(value: Column, cuts: list[int]) -> Column:
        return sum(((value >= c).cast("int") for c in cuts), F.lit(0))

    def side(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}0-9_]"), 2).otherwise(3)

    def groups(hit: Column) -> Column:
        """Its groups of digits."""
        return F.split(F.trim(F.regexp_replace(hit, "[^0-9]+", " ")), " ")

    def found(s: Column) -> Column:
        hit, digits = s["hit"], digits_of(s["hit"])
        n = F.length(digits)
        octet = hit.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(generator).alias("generator"),
            level(n, [1, 7, 8, 10, 11, 13, 15, 16, 19, 20]).alias("digits"), level(F.length(hit), [8, 12, 16, 20, 32, 64]).alias("length"),
            sum((F.instr(hit, c) > 0).cast("int") for c in (" ", "-", ".", ":", "/")).alias("kinds"),
            hit.startswith("+").cast("int").alias("plus"), F.contains(hit, F.lit("(")).cast("int").alias("parens"),
            F.when(n.between(12, 19), luhn(digits)).otherwise(False).cast("int").alias("luhn"),
            F.when(octet, octets(hit)).otherwise(False).cast("int").alias("octets"),
            F.when(hit.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"), 2)
            .when(hit.rlike(r"^[\p{L}0-9._%+-]+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.[\p{L}]{2,}$"), 1).otherwise(0).alias("at"),
            side(F.substring(text, s["start"], F.lit(1)) if generator else F.lit("")).alias("left"),
            side(F.substring(text, s["end"] + 1, F.lit(1)) if generator else F.lit("")).alias("right"),
            F.least(F.size(groups(hit)), F.lit(8)).alias("groups"), F.least(F.length(F.coalesce(F.get(groups(hit), 0), F.lit(""))), F.lit(9)).alias("lead"),
            F.least(F.length(F.coalesce(F.element_at(groups(hit), -1), F.lit(""))), F.lit(9)).alias("tail"),
            F.least(F.length(F.regexp_replace(hit, r"[^.,/:]", "")), F.lit(4)).alias("dots"),
        )

    kept = spans if generator == 0 else F.filter(spans, lambda s: F.length(digits_of(s["hit"])) >= LEAST_DIGITS)
    return F.transform(kept, found)


def analysed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, the strict spans by kind, and ``proposed``."""
    text = F.col("text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumns({"__at": F.contains("text", F.lit("@")), "__digit": F.col("text").rlike("[0-9]"), "__plus": F.contains("text", F.lit("+"))})
    at, digit, plus = F.col("__at"), F.col("__digit"), F.col("__plus")
    df = with_spans(df, "text", PATTERNS | GENERATORS, {
        "email": at, "ip": digit, "card": digit, "phone": plus & digit, "around_at": at, "digit_chain": digit, "digit_word": digit,
    })
    holds = lambda kind: lambda s: valid(kind, s["hit"])
    df = df.withColumns({k: F.filter(k, holds(k)) for k in KINDS})
    df = df.withColumn("proposed", F.concat(*[proposals(i, F.col(g), text) for i, g in enumerate(GENERATORS)]))
    return df.select("doc_id", *KINDS, "proposed")


def made_up(draw: random.Random) -> tuple[str, str, str, bool]:
    """What stands before a value, the value, what stands behind, and whether it is personal."""
    n = lambda k, first="0123456789": draw.choice(first) + "".join(draw.choice("0123456789") for _ in range(k - 1))
    some = "123456789"
    word = lambda letters="abcdefghijklmnopqrstuvwxyz": "".join(draw.choice(letters) for _ in range(draw.randint(3, 9)))
    wide = "abcdefghiklmnoprstuvwzäöüéèñçøßłж"

    def card(length: int, right: bool) -> str:
        body = n(length - 1, "3456")
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
        return body + str((-total + (0 if right else draw.randint(1, 9))) % 10)

    def grouped(digits: str, mark: str) -> str:
        return mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    area, mark = n(3, "23456789"), draw.choice("-. ")
    personal = [
        lambda: f"({area}) {n(3, some)}-{n(4)}", lambda: f"{area}-{n(3, some)}-{n(4)}", lambda: f"{area}.{n(3, some)}.{n(4)}", lambda: f"1-{area}-{n(3, some)}-{n(4)}",
        lambda: f"00{n(2, some)} {n(2, some)} {n(draw.randint(5, 8))}", lambda: f"00{n(2, some)} {n(3, some)} {n(3)} {n(4)}", lambda: f"0{n(2, some)}/{n(draw.randint(6, 8), some)}",
        lambda: f"0{n(3, some)} {n(3)} {n(3)}", lambda: f"(0{n(1, some)}) {n(4, some)} {n(4)}", lambda: f"+{n(1, some)} ({area}) {n(3)}-{n(4)}",
        lambda: f"{n(3, some)}-{n(2)}-{n(4)}", lambda: f"{word(wide)}@{word(wide)}.{draw.choice(('de', 'fr', 'com', 'org', 'рф'))}",
        lambda: f"{word()}.{word()}@{word()}.{draw.choice(('com', 'example.org'))}", lambda: f"{word()}{n(2)}@{word(wide)}.{word()}.net",
        lambda: grouped(n(draw.choice((20, 22, 24)), some), " "), lambda: card(16, True), lambda: grouped(card(16, True), draw.choice(" -")),
    ]
    harmless = [
        lambda: f"{n(4, '12')}-0{n(1, some)}-{n(2, '012')}", lambda: f"{n(2, '0123')}.{n(2, '01')}.{n(4, '12')}", lambda: f"{n(2, '01')}/{n(2, '0123')}/{n(4, '12')}",
        lambda: f"{n(4, '12')}-{n(2, '01')}-{n(2, '012')} {n(2, '012')}:{n(2, '012345')}:{n(2, '012345')}", lambda: f"{n(1)}.{n(draw.randint(7, 14))}",
        lambda: f"{n(1, some)},{n(3)},{n(3)}.{n(2)}", lambda: f"{n(1, some)}.{n(3)}.{n(3)},{n(2)}", lambda: n(draw.choice((7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 18, 20, 24)), some),
        lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"{n(draw.randint(4, 7), some)}-{n(draw.randint(4, 7), some)}", lambda: f"{n(2)}.{n(1)}.{n(5)}.{n(1)}",
        lambda: card(16, False), lambda: grouped(card(16, False), draw.choice(" -")), lambda: grouped(n(15, some), draw.choice(" -")),
        lambda: f"{n(3, '3456789')}.{n(3, '3456789')}.{n(2)}.{n(1)}", lambda: f"{word()}@{word()}", lambda: f"{n(2)}:{n(2)}:{n(2)}:{n(2)}:{n(2)}", lambda: f"{n(4, some)} {n(4, some)}",
        lambda: "{}", lambda: "{}", lambda: "{}", lambda: f"{n(4, some)} {mark} {n(4, some)}",
    ]
    before, behind = draw.choice((("", ""), ("", "."), ("", ","), ("(", ")"), ('"', '"'), ("\n", "\n"), (": ", ";"), ("", "")))
    if draw.random() < 0.5:
        value = draw.choice(personal)()
        if draw.random() < 0.15 and "@" not in value and " " not in value:
            behind = " " + n(draw.randint(2, 4))  # another number beside it
        return before, value, behind, True
    value = draw.choice(harmless)()
    if value == "{}":  # digits inside of hexadecimal numbers, names and keys
        value = draw.choice(("".join(draw.choice("0123456789abcdef") for _ in range(draw.randint(24, 64))),
                             f"{word()}{n(draw.randint(7, 16))}{word()}", f"{word().upper()}{n(draw.randint(8, 12))}", f"{word()}_{n(10)}.png"))
    return before, value, behind, False


def seeded_texts(words: list[str], seed: int, count: int) -> list[tuple[int, str, int, int]]:
    """``id, text, start, end`` (of the personal value; -1 if there is none) of made-up values between given words."""
    draw, out = random.Random(seed), []
    for k in range(count):
        before, value, behind, personal = made_up(draw)
        head = " ".join(draw.choice(words) for _ in range(draw.randint(0, 4))) if words else ""
        head += (" " if head else "") + before
        tail = behind + " " + " ".join(draw.choice(words) for _ in range(draw.randint(0, 4)) if words)
        out.append((k, head + value + tail, len(head) if personal else -1, len(head) + len(value) if personal else -1))
    return out


def sample_words(docs: DataFrame, text_col: str, texts: int = SAMPLE_TEXTS) -> list[str]:
    """Words without digits from the beginnings of at most so many texts, in a fixed order."""
    heads = docs.select(F.substring(F.col(text_col).cast("string"), 1, SAMPLE_CHARS).alias("t")).where("t <> ''").orderBy(F.xxhash64("t"), "t").limit(texts)
    return sorted({w for r in heads.collect() for w in r[0].split()[:-1] if w.isalpha()})


def pattern_counts(spark, texts: list[tuple[int, str, int, int]]) -> list[tuple[tuple[int, ...], float, float]]:
    """Per feature pattern the proposals in made-up texts, and those that are the value: most of the one is most of the other."""
    given = spark.createDataFrame(texts, "doc_id long, text string, a int, b int")
    found = analysed(given, "doc_id", "text").join(given.drop("text"), "doc_id")

    def known(p: Column) -> Column:
        common = F.least(F.col("b"), p["end"]) - F.greatest(F.col("a"), p["start"])
        return (F.col("a") >= 0) & (common * 10 >= F.greatest(F.col("b") - F.col("a"), p["end"] - p["start"]) * 8)

    labelled = F.transform("proposed", lambda p: F.struct(*[p[f].alias(f) for f in FEATURES], known(p).cast("int").alias("y")))
    rows = found.select(F.explode_outer(labelled).alias("p")).where("p IS NOT NULL")
    counts = rows.groupBy(*[F.col(f"p.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.sum("p.y").alias("y"))
    return sorted((tuple(features), float(n), float(y)) for *features, n, y in counts.collect())


def fit_trees(rows: list[tuple[tuple[int, ...], float, float]]) -> list:
    """Boosted trees by logistic loss on rows (features, n, known). A tree is a value or (feature, level, below, from)."""
    scores = [0.0] * len(rows)

    def grow(at: list[int], slopes: list[float], curves: list[float], depth: int):
        g, h = sum(slopes[i] for i in at), sum(curves[i] for i in at)
        best, choice = 1e-6, None
        if depth:
            for f in range(len(FEATURES)):
                by: dict[int, list[float]] = {}
                for i in at:
                    sums = by.setdefault(rows[i][0][f], [0.0, 0.0, 0.0])
                    sums[0] += slopes[i]
                    sums[1] += curves[i]
                    sums[2] += rows[i][1]
                left = [0.0, 0.0, 0.0]
                weight = sum(v[2] for v in by.values())
                levels = sorted(by)
                for a, b in zip(levels, levels[1:]):
                    left = [x + y for x, y in zip(left, by[a])]
                    if min(left[2], weight - left[2]) < LEAF:
                        continue
                    gain = left[0] ** 2 / (left[1] + 1) + (g - left[0]) ** 2 / (h - left[1] + 1) - g * g / (h + 1)
                    if gain > best:
                        best, choice = gain, (f, b)
        if choice is None:
            return RATE * g / (h + 1)
        f, b = choice
        return (f, b, grow([i for i in at if rows[i][0][f] < b], slopes, curves, depth - 1),
                grow([i for i in at if rows[i][0][f] >= b], slopes, curves, depth - 1))

    trees = []
    for _ in range(TREES if rows else 0):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = grow(list(range(len(rows))), [y - n * q for (_, n, y), q in zip(rows, p)], [n * q * (1 - q) for (_, n, _), q in zip(rows, p)], DEPTH)
        trees.append(tree)
        scores = [s + value_of(tree, x) for s, (x, _, _) in zip(scores, rows)]
    return trees


def value_of(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[3] if features[tree[0]] >= tree[1] else tree[2]
    return tree


def threshold(trees: list, rows: list[tuple[tuple[int, ...], float, float]], precision: float = PRECISION, band: float = BAND) -> float:
    """The lowest score down to which each band of scores has at least ``precision`` of true ones (one virtual miss a band); infinite if none.

    A band weighs ``band`` or more, so what is plainly true above doesn't make up for what is doubtful below.
    """
    if not trees:
        return math.inf
    by: dict[float, list[float]] = {}
    for x, n, y in rows:
        sums = by.setdefault(round(sum(value_of(t, x) for t in trees), 9), [0.0, 0.0])
        sums[0] += n
        sums[1] += y
    out, n, y = math.inf, 0.0, 0.0
    scores = sorted(by, reverse=True)
    for score in scores:
        n, y = n + by[score][0], y + by[score][1]
        if n < band and score != scores[-1]:
            continue
        if y < precision * (n + (1.0 if n < band else 0.0)):
            break
        out, n, y = score - 1e-6, 0.0, 0.0
    return out


def fit(docs: DataFrame, text_col: str = "text") -> tuple[list, float]:
    """Trees and threshold, each from ``SEEDED`` made-up texts of its own; the corpus gives at most ``SAMPLE_TEXTS`` beginnings of texts."""
    words = sample_words(docs, text_col)
    fitted, other = (pattern_counts(docs.sparkSession, seeded_texts(words, seed, SEEDED)) for seed in (11, 12))
    trees = fit_trees(fitted)
    return trees, threshold(trees, other)


def score(trees: list, p: Column) -> Column:
    def expression(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(p[FEATURES[tree[0]]] >= tree[1], expression(tree[3])).otherwise(expression(tree[2]))

    return sum((expression(t) for t in trees), F.lit(0.0))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id``, strict spans ``email, ip, card, phone`` and ``extra``, arrays of ``start, end`` by start.

    An ``extra`` span touches no strict one; of overlapping proposals the best
    score wins, then the first, then the longest. Null texts are empty and have no spans; repeated
    rows get equal spans, null ids stay; without rows there are no rows. Other
    columns of ``docs`` are not read.
    """
    found = analysed(docs, id_col, text_col)
    trees, least = fit(docs, text_col)
    none = F.array().cast("array<struct<start:int,end:int>>")
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    strict = [F.transform(k, bare).alias(k) for k in KINDS]
    if math.isinf(least):
        return found.select("doc_id", *strict, none.alias(EXTRA))
    touches = lambda s, p: (s["start"] < p["end"]) & (p["start"] < s["end"])

    def fresh(p: Column) -> Column:
        out = score(trees, p) >= least
        for k in KINDS:
            out = out & ~F.exists(k, lambda s: touches(s, p))
        return out

    chosen = F.sort_array(F.transform(F.filter("proposed", fresh), lambda p: F.struct(
        (-score(trees, p)).alias("s"), p["start"].alias("start"), (-p["end"]).alias("e"))))
    found = found.withColumn("__chosen", F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), (-c["e"]).alias("end"))))
    extra = F.aggregate("__chosen", none, lambda done, p: F.when(F.exists(done, lambda s: touches(s, p)), done).otherwise(F.concat(done, F.array(p))))
    return found.select("doc_id", *strict, F.sort_array(extra).alias(EXTRA))


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the strict spans and all spans as text, of the rows of :func:`find`."""
    named = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    base = F.concat(*[named(k) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, named(EXTRA)), ",").alias("spans"),
        F.size(EXTRA).cast("long").alias("n_extra"),
    )
