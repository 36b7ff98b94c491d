"""Near-duplicates by min-max hashing.

A document is the set of its five-word shingles. Every permutation of the
shingles gives two signature values, the smallest and the largest, so a
signature of 448 values costs 224 hash evaluations a shingle. Values are banded
(64 bands of 7; two sets of similarity 0.75 share no band with a probability of
1e-4), documents that share a band are candidates, and candidates are confirmed
on their full sets.

Copies with equal sets are one node from the start. In a band's bucket every
member is compared with one pivot, not with all others. Where that leaves a
bucket with more than one component, its smaller components are looked up in
blocks of the others, inside tasks: no pair that might still join two components
is left out, and no table of pairs within a group is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliotree.functions.durable import stored
from foliotree.llm.batches import small_batches
from foliotree.llm.components import components
from foliotree.llm.keep import undecided_and_one_each
from foliotree.llm.key_filter import flagged, folded

WIDTH, BANDS, ROWS, PERCENT = 5, 64, 7, 75
#: Ids at or above this stand for rows without an id.
NO_ID = 1 << 62
#: From here on nodes are numbered whose smallest id another set has as well.
OWN_NUMBER = NO_ID + (1 << 61)
MAX_WORDS = 150_000
TILE = 2048
#: A block or chunk of nodes that are compared inside one task.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 20

_U = np.uint64
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=_U)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        number = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_WORDS:
            self[word] = number
        return number


_WORDS = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[4]
    x = (x ^ (x >> _U(29))) * _MIX[1]
    return x ^ (x >> _U(32))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text, A-Z lower-cased.

    Fewer words than ``width`` are one shingle; no words give no shingle. (On
    bytes, ``lower`` and ``split`` know exactly A-Z and the six ASCII blanks.)
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, _U)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    take = min(width, len(words))
    total = np.full(len(words) - take + 1, take, dtype=_U)
    for k in range(take):
        total = _mixed(total + hashes[k : len(words) - take + 1 + k] * _MIX[k % 5])
    return np.unique(total)


class Signer:
    """Band keys of a shingle set. All constants come from ``seed``."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        if bands % 2:
            raise ValueError("half of the bands are of minima, half of maxima")
        draw = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, count = bands, rows, bands * rows // 2
        self.factor = draw.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
        self.shift = draw.integers(0, 1 << 32, count, dtype=np.uint32)
        self.weights = draw.integers(0, 1 << 63, rows, dtype=_U) | _U(1)
        self.band = draw.integers(0, 1 << 63, bands, dtype=_U)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> _U(32)).astype(np.uint32)
        low = high = None
        for at in range(0, len(x), TILE):
            y = x[at : at + TILE, None] * self.factor + self.shift
            a, b = y.min(axis=0), y.max(axis=0)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        values = np.concatenate([low, high]).reshape(self.bands, self.rows).astype(_U)
        return _mixed((values * self.weights).sum(axis=1, dtype=_U) + self.band).view(np.int64)


def _texts(batch, at: int) -> list:
    return batch.column(at).cast(pa.binary()).to_pylist()


def _digest(text: Column) -> Column:
    """Of a text as it is, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _key(shingles: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(shingles.tobytes())


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, row_id, n_shingles, set_key, bands, digest`` (of the text) of every row; an empty set has neither key nor bands."""
    small_batches(docs.sparkSession)

    def run(batches):
        sign = Signer(bands, rows)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                found = shingle_set(text, width)
                key = _key(found) if len(found) else None
                row_id = doc_id if doc_id is not None else NO_ID | int(key[:15], 16) if key else NO_ID
                out.append((doc_id, row_id, len(found), key, sign(found) if len(found) else None))
            ids, row_ids, sizes, keys, signed = zip(*out) if out else [()] * 5
            lengths = np.array([0 if s is None else bands for s in signed], np.int32)
            flat = [s for s in signed if s is not None]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(row_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32),
                                         pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))),
                batch.column(2),
            ], names=["doc_id", "row_id", "n_shingles", "set_key", "bands", "digest"])
        _WORDS.clear()  # a worker outlives its tasks

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _digest(F.col(text_col)).alias("digest")).mapInArrow(
        run, "doc_id long, row_id long, n_shingles long, set_key string, bands array<bigint>, digest binary")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """From ``doc_id, text``: ``row_id, set_key, shingles`` (binary) of the rows that have shingles."""
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                found = shingle_set(text, width)
                if len(found):
                    key = _key(found)
                    out.append((doc_id if doc_id is not None else NO_ID | int(key[:15], 16), key, found.tobytes()))
            ids, keys, sets = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(sets, pa.binary())],
                                             names=["row_id", "set_key", "shingles"])
        _WORDS.clear()

    return texts.mapInArrow(run, "row_id long, set_key string, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sets have at least ``percent`` of their union in common."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])

    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across(nodes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels after all links between different components that share a bucket.

    Where a bucket holds several components, the nodes outside its largest one
    are queries against all its nodes. Nodes are dealt to blocks (neighbours by
    the smallest node of their buckets, at most about ``BLOCK_NODES`` nodes and
    ``BLOCK_SHINGLES`` shingles) and queries to chunks of the same size, so a row
    is a query and a block, never a pair; a task looks a chunk's shingles up in
    the sorted shingles of a block and reports one link for a query and component.
    """
    exploded = nodes.join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"), F.explode_outer("bands").alias("key"))
    mixed = exploded.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("node").alias("low")).where("l0 < l1").select("key", "low")
    still = stored(exploded.join(stored(mixed, "mixed"), "key"), "open")
    if still.isEmpty():
        return labels

    def split(df: DataFrame, by: str, out: str) -> DataFrame:
        """Rows (by, node, n) with ``out``, so many parts of a ``by`` that none is larger than a block."""
        sizes = df.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("__parts"))
        return df.join(sizes, by).withColumn(out, F.pmod(F.xxhash64("node"), F.col("__parts")).cast("int")).drop("__parts")

    near = still.groupBy("node", "n", "label").agg(F.min("low").alias("g"))
    blocks = stored(split(near, "g", "part").withColumn("block", F.xxhash64("g", "part")).select("block", "node", "n", "label"), "blocks")
    # Of a bucket's components the one with most nodes asks nothing.
    largest = still.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"))
    asking = still.join(largest, "key").where(F.col("label") != F.col("top.label")).select("key", "node", "n", "label")
    asked = still.select("key", "node").join(blocks.select("node", "block"), "node").select("key", "block").distinct()
    queries = stored(split(asking.join(asked, "key").select("block", "node", "n", "label").distinct(), "block", "chunk"), "queries")
    members = blocks.join(queries.select("block", "chunk").distinct(), "block").join(sets, "node").select("block", "chunk", "node", "label", "shingles")
    asking_sets = queries.join(sets, "node").select(*[F.col(c).alias(f"q_{c}") for c in ("block", "chunk", "node", "label", "shingles")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [np.frombuffer(x.as_buffer(), _U) for x in left.column("shingles")]
        out: list[tuple[int, int]] = []
        if held and right.num_rows:
            sizes = np.array([len(x) for x in held])
            values = np.concatenate(held)
            order = np.argsort(values, kind="stable")
            values, owners = values[order], np.repeat(np.arange(len(held)), sizes)[order]
            ids, own = left.column("node").to_numpy(), left.column("label").to_numpy()
            for node, label, x in zip(*(right.column(f"q_{c}").to_pylist() for c in ("node", "label")), right.column("q_shingles")):
                x = np.frombuffer(x.as_buffer(), _U)
                first, last = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                counts = last - first
                hits = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                common = np.bincount(owners[hits], minlength=len(held))
                linked = np.flatnonzero((100 * common >= percent * (len(x) + sizes - common)) & (own != label))
                _, one = np.unique(own[linked], return_index=True)
                out += [(node, int(ids[k])) for k in linked[one]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    links = members.groupBy("block", "chunk").cogroup(asking_sets.groupBy("q_block", "q_chunk")).applyInArrow(meet, "a long, b long")
    return components(stored(links, "links"), labels)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id that the row is connected with by links
    of similarity ``percent`` or more, its own included. Null and empty texts,
    and texts of blanks, have no shingles and link with nothing. Rows with equal
    sets are linked; repeated rows (same id) share their result. A row without
    an id links like others and never names a component; a component without any
    id has a null one, and its rows are kept. Ids must be below 2 ** 62. No rows
    give no rows. Other columns of ``docs`` are not read.
    """
    named = _placed(docs, id_col, text_col, percent, width, bands, rows).withColumn("component_id", F.when(F.col("least") < F.lit(NO_ID), F.col("least")))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_id, n_shingles, digest, label, least``.

    ``label`` is a number of the row's component alone, null without shingles;
    ``least`` the smallest ``row_id`` in it.
    """
    signed = stored(signatures(docs, id_col, text_col, width, bands, rows), "signatures")
    classes = stored(signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row_id").alias("row_id"), F.count("*").alias("rows")), "classes")
    # A set is a node, named by its smallest id. Of sets that share that id all but one get a number of their own.
    shared = stored(classes.groupBy("row_id").agg(F.count("*").alias("n"), F.min("set_key").alias("first")).where("n > 1").select("row_id", "first"), "shared")
    unique = shared.isEmpty()
    if unique:
        classes = classes.withColumn("node", F.col("row_id"))
    else:
        own = F.lit(OWN_NUMBER) + F.monotonically_increasing_id()
        classes = stored(classes.join(shared, "row_id", "left").select(
            "set_key", "row_id", "rows", F.when(F.coalesce(F.col("set_key") != F.col("first"), F.lit(False)), own).otherwise(F.col("row_id")).alias("node")), "numbered")
    # Bands are wide: only rows that may not be alone with their set are moved to choose one of them.
    told = flagged(signed.where("set_key IS NOT NULL"), folded(classes.where((F.col("rows") > 1) | (F.col("node") != F.col("row_id"))), F.col("set_key")),
                   "several", F.col("set_key")).withColumn("n", F.col("n_shingles"))
    alone = told.where("NOT several").select(F.col("row_id").alias("node"), "row_id", "set_key", "n", "bands")
    first = told.where("several").join(classes.hint("merge"), ["set_key", "row_id"]).select("node", "row_id", "set_key", "n", "bands")
    banded = stored(alone.unionByName(first.dropDuplicates(["node", "set_key"])), "banded")
    entries = banded.select("node", F.explode_outer("bands").alias("key"))
    buckets = stored(entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low"), "buckets")
    met = flagged(entries, folded(buckets, F.col("key")), "met", F.col("key")).where("met")
    checked = stored(
        met.join(buckets.hint("merge"), "key").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "pairs"
    )

    nodes = stored(checked.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(banded, "node"), "nodes")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The nodes grow with the documents, so this is a shuffle at every size, but only of texts that may be wanted.
    ids = stored(nodes.select(F.col("row_id").alias("doc_id")).distinct(), "ids")
    likely = flagged(texts, folded(ids, F.col("doc_id")), "likely", F.col("doc_id")).where("likely")
    wanted = likely.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    sets = stored(
        _sets(wanted.unionByName(texts.where("doc_id IS NULL")), width)
        .join(nodes.select("node", "row_id", "set_key"), ["row_id", "set_key"])
        .select("node", "shingles").dropDuplicates(["node"]), "sets"
    )
    labels = components(stored(_confirmed(checked, sets, percent), "links"))

    labels = _across(nodes, labels, sets, percent)

    labelled = classes.join(labels, "node", "left").select("set_key", "row_id", F.coalesce("label", "node").alias("label"))
    if unique:
        labelled = labelled.withColumn("least", F.col("label"))
    else:
        labelled = stored(labelled, "labelled")
        labelled = labelled.join(labelled.groupBy("label").agg(F.min("row_id").alias("least")), "label")
    placed = signed.select("doc_id", "row_id", "n_shingles", "set_key", "digest").join(labelled.select("set_key", "label", "least"), "set_key", "left")
    return placed.select("doc_id", "row_id", "n_shingles", "digest", "label", F.coalesce("least", "row_id").alias("least"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each component, one of its smallest id; columns as before.

    Rows are told apart by id and text, so a row goes or stays by its own text
    where ids are shared. Rows without shingles stay, but of those that share id
    and text only one.
    """
    placed = stored(_placed(docs, id_col, text_col, percent).select("doc_id", "row_id", "digest", "label", "least"), "placed")
    dropped = placed.where("row_id <> least").select("doc_id", "digest", F.lit(False).alias("again")).distinct()
    # Where several rows have the smallest id of a component, one of their texts stays.
    first = placed.where("row_id = least").withColumn("alone", F.when(F.col("label").isNull(), F.struct(F.col("row_id"), F.col("digest"))))
    texts = first.groupBy("label", "alone", "doc_id", "digest").agg(F.count("*").alias("n"))
    several = stored(texts.groupBy("label", "alone").agg(F.sum("n").alias("n"), F.min("digest").alias("top")).where("n > 1"), "several").select(
        F.col("label").alias("l"), F.col("alone").alias("a"), "top")
    contested = texts.join(several, F.col("label").eqNullSafe(F.col("l")) & F.col("alone").eqNullSafe(F.col("a")))
    decided = stored(dropped.unionByName(contested.select("doc_id", "digest", (F.col("digest") == F.col("top")).alias("again"))), "decided")
    return undecided_and_one_each(docs, id_col, _digest(F.col(text_col)), decided)
