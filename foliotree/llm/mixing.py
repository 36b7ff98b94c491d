"""Mixing sources to target weights: capped water-filling.

Every source gets a share of the budget by its weight, at most ``max_epochs``
times its own size. What a clamped source cannot take is dealt out again among
the others by weight, until no source is above its cap. A source's target is
then met by whole repetitions of all of it and a seeded fraction of it: its
documents in the order of a seeded hash, from the first on, until the rest of
the target is used up. The document at the cut is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliotree.functions.durable import stored

BLANKS = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"
# A seeded order of a source is cut in two steps, by so many slots of the hash each, so that the documents
# that must be summed up one after another are about one in SLOTS ** 2 of the source.
SLOTS = 4096


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """Weights dealt to the sources in the order of their names, null last. ``sources`` is one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, cycle))), F.pmod(rank, F.lit(len(cycle))) + 1))


def water_fill(sources: DataFrame, budget_factor: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to one row per source (``source, source_size, weight``).

    Only sums over the sources come to the driver. Each round clamps the sources
    that their share would take above their cap; the level of the others only
    rises, so a clamped source stays clamped, and rounds end when none is added.
    Without any words all targets are 0. The budget is ``budget_factor`` of all
    sizes; beyond ``max_epochs`` of them all sources end at their cap. A source
    without weight or with a null one gets nothing.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    budget = float(budget_factor) * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        full = (weight * F.lit(level) >= cap) if clamped >= 0 else F.lit(False)
        n, used, free = sources.agg(
            F.coalesce(F.sum(full.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, weight)), F.lit(0.0)),
        ).first()
        if n == clamped:
            break
        clamped = n
        if not free:
            break
        level = (budget - used) / free
    return sources.withColumn("target", F.least(weight * F.lit(level), cap))


def mix(docs: DataFrame, weights, seed: str = "mix", budget_factor: float = 1.5, max_epochs: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """What the mix takes of every row: ``doc_id, size, source_size, target, taken``.

    ``weights`` makes ``source, source_size, weight`` of ``source, source_size``
    (for instance :func:`cyclic_weights`). ``taken`` is in words, repeats
    counted; ``taken // size`` times the document is taken whole, ``taken %
    size`` words of it once more. A null source is a source. Rows without words
    are taken as 0 words. Repeated rows are rows like others. With ``keep`` the
    columns of ``docs`` come first, and the new ones are a struct ``__mix`` behind
    them (with more underscores if ``docs`` has a column of that name).

    Documents are taken in the order of the seeded hash of their id; where ids are
    shared or null the size and then a hash of the text decide. Rows that are equal
    in all of this are numbered, so a source meets its target with any ties.

    Sums per source are combined before they are shuffled, the documents
    themselves are only joined with one narrow row per source, which Spark
    broadcasts if its stored size is below the limit and shuffles otherwise.
    """
    size = word_count(F.col(text_col))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    slot = lambda at: F.conv(F.substring("__order", at, 3), 16, 10).cast("int")
    own = [F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), size.alias("size"), order.alias("__order"),
           F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__text")]
    if keep:
        base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), *own)
        narrow = stored(base.select("source", "size", "__order", "__text"), "sizes")
    else:
        base = narrow = stored(docs.select(*own), "sizes")  # texts are read once; what follows reads narrow columns
    by_slot = stored(
        narrow.groupBy("source", slot(1).alias("slot")).agg(F.sum("size").alias("words")), "slots"
    )
    sources = stored(water_fill(
        stored(weights(by_slot.groupBy("source").agg(F.sum("words").alias("source_size"))), "sources"), budget_factor, max_epochs
    ), "targets")
    whole = F.floor(F.coalesce(F.floor(F.col("target") + 0.5), F.lit(0)) / F.greatest("source_size", F.lit(1))).cast("long")
    rest = (F.floor(F.col("target") + 0.5) - whole * F.col("source_size")).cast("long")
    plan = stored(sources.select(F.col("source").alias("s"), "source_size", "target", whole.alias("whole"), rest.alias("rest")), "plan")
    cuts = _cuts(narrow, by_slot, plan.where("rest > 0").select("s", "rest"), slot)
    plan = stored(plan.join(cuts.withColumnRenamed("s", "s1"), F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1"), "plan")
    told = base.join(plan, F.col("source").eqNullSafe(F.col("s")), "left")
    ordered = lambda order, size, text: F.struct(F.col(order), F.col(size), F.pmod(text, F.lit(SLOTS)).alias("slot"), F.col(text))
    place, cut = ordered("__order", "size", "__text"), ordered("cut_order", "cut_size", "cut_text")
    cut_here = F.coalesce(F.col("cut_order").isNotNull() & (place == cut), F.lit(False))
    before = F.col("cut_order").isNotNull() & (place < cut)
    rest_of_plan = told.where(~cut_here).withColumn("__extra", F.when(before, F.col("size")).otherwise(0))
    numbered = _numbered(stored(told.where(cut_here).withColumn("__row", F.monotonically_increasing_id()), "tied"))
    at_cut = numbered.withColumn("__extra", F.greatest(F.least(F.col("cut_words") - F.col("__n") * F.col("size"), F.col("size")), F.lit(0))).drop("__n", "__row")
    out = rest_of_plan.unionByName(at_cut)
    taken = F.coalesce(F.col("whole") * F.col("size") + F.col("__extra"), F.lit(0)).cast("long")
    columns = {"doc_id": F.col("doc_id"), "size": F.col("size"), "source_size": F.col("source_size"),
               "target": F.round("target", 6), "taken": taken}
    if keep:
        name = "__mix"
        while name in docs.columns:
            name += "_"
        return out.select("__doc.*", F.struct(*[c.alias(k) for k, c in columns.items()]).alias(name))
    return out.select(*[c.alias(k) for k, c in columns.items()])


def _cuts(narrow: DataFrame, by_slot: DataFrame, wanted: DataFrame, slot) -> DataFrame:
    """``s, cut_order, cut_size, cut_text, cut_words``: of each source in ``wanted (s, rest)`` the place where its rest ends.

    The place is sought by one key after another: two slots of the hash of the id,
    that hash, the size, a slot of the text's hash and that hash. What is summed up
    one after another is the few values of a key within those before it, so no
    window grows with the rows of a source, whatever they share.
    """
    keys = [slot(1), slot(4), F.col("__order"), F.col("size"), F.pmod("__text", F.lit(SLOTS)), F.col("__text")]
    rows, path = narrow, wanted.withColumn("before", F.lit(0).cast("bigint"))
    for level, key in enumerate(keys):
        held = path.withColumnRenamed("s", "s0")
        if level:
            sums = rows.groupBy("source", key.alias("key")).agg(F.sum("size").alias("words"))
        else:
            sums = by_slot.withColumnRenamed("slot", "key")
        named = sums.join(held, F.col("source").eqNullSafe(F.col("s0")))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("key")) + F.col("before")
        found = named.withColumn("to", running).where("to >= rest AND to - words < rest")
        path = stored(found.select(F.col("source").alias("s"), "rest", (F.col("to") - F.col("words")).alias("before"), "key"), "cut")
        on = F.col("source").eqNullSafe(F.col("s")) & (key == F.col("key"))
        rows = rows.join(path.select("s", "key"), on, "left_semi")
        if level == 1:
            rows = stored(rows, "near-cut")  # about one row in SLOTS ** 2, or rows that share an id
        path = path.drop("key")
    place = rows.groupBy("source").agg(F.first("__order").alias("cut_order"), F.first("size").alias("cut_size"), F.first("__text").alias("cut_text"))
    return place.join(path, F.col("source").eqNullSafe(F.col("s"))).select("s", "cut_order", "cut_size", "cut_text", (F.col("rest") - F.col("before")).alias("cut_words"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` with ``__n``, their number within ``source`` from 0 in the order of ``__row``; counted by partitions, so no window holds a source."""
    part = F.shiftright("__row", 33)
    counts = rows.groupBy("source", part.alias("p")).agg(F.count("*").alias("n"))
    sums = counts.withColumn("first", F.sum("n").over(Window.partitionBy("source").orderBy("p")) - F.col("n")).select(F.col("source").alias("s2"), "p", "first")
    within = F.row_number().over(Window.partitionBy("source", "__p").orderBy("__row")) - 1
    placed = rows.withColumn("__p", part).withColumn("__i", within)
    return placed.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("__p") == F.col("p"))).withColumn(
        "__n", F.col("first") + F.col("__i")).drop("s2", "p", "first", "__p", "__i")


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mixed documents: one row per repetition, the columns as before.

    Of a fractional repetition the row's text is its first words, joined by one
    space; there is about one such row per source.
    """
    *columns, mix_col = mixed.columns  # the mix stands behind the given columns
    doc = mixed.select(F.struct(*columns).alias("doc"), F.col(mix_col).alias("mix"))
    words = F.split(F.regexp_replace(F.col("doc")[text_col], f"^{BLANKS}+", ""), f"{BLANKS}+")
    parts = F.col("mix.taken") % F.col("mix.size")
    times = (F.col("mix.taken") / F.col("mix.size")).cast("int")
    repeats = doc.where("mix.size > 0 AND mix.taken > 0").select("doc", F.explode(F.concat(
        F.array_repeat(F.lit(-1).cast("long"), times),
        F.when(parts > 0, F.array(parts)).otherwise(F.array().cast("array<bigint>")),
    )).alias("words"))
    text = F.when(F.col("words") < 0, F.col("doc")[text_col]).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")
    )
    return repeats.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in columns])
