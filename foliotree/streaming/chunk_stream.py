"""L2: fold the chunks of streamed answers into messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliotree.operators.answers import PART_CHUNKS, join_parts, kept_chunk

FOLDED = "message_id string, part int, content string, final boolean, expired boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State of several values a key needs this provider; a session that names another one for itself is told so by Spark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class FoldPart(StatefulProcessor):
    """One part of a message. An event is appended to the part's list, nothing that is there is written again.

    Beside the list the state holds one bit per sequence number of the part, so
    that a replayed event is known without reading the list, which is read once,
    when the part is whole. A part whose events come all at once has no list:
    every call to the state is a round trip between Python and the JVM.
    """

    def __init__(self, part_chunks: int) -> None:
        self.part_chunks = part_chunks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "seq int, chunk string")
        self.progress = handle.getValueState("progress", "bits binary, n int, last int, emitted boolean, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        message_id, part = key
        first = part * self.part_chunks
        bits, n, last, emitted, timer = self.progress.get() or (bytes(-(-self.part_chunks // 8)), 0, None, False, None)
        seen, newest, fresh, kept = bytearray(bits), None, [], n > 0
        for batch in rows:
            latest = batch["ts"].max()
            newest = latest if newest is None else max(newest, latest)
            done = batch["done"].to_numpy()
            if done.any():
                last = int(batch["seq"].to_numpy()[done.argmax()])
            for seq, chunk in zip(batch["seq"].tolist() if not emitted else [], batch["chunk"].tolist()):
                at, bit = divmod(seq - first, 8)
                if not seen[at] >> bit & 1:
                    seen[at] |= 1 << bit
                    fresh.append((seq, chunk))
        n += len(fresh)
        end = last + 1 if last is not None else first + self.part_chunks
        whole = not emitted and n == end - first
        if fresh and (kept or not whole):
            self.chunks.appendList(fresh)
        if whole:
            held = dict(self.chunks.get() if kept else fresh)
            yield pd.DataFrame({
                "message_id": [message_id], "part": [part],
                "content": ["".join(held[s] for s in range(first, end))], "final": [last is not None], "expired": [False],
            })
            # A finished part only remembers that it is finished, until replays of it are too late to count.
            emitted, seen = True, bytearray()
            if kept:
                self.chunks.clear()
        at = max(int(newest.timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1) + 1
        if timer is None or at > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.progress.update((bytes(seen), n, last, emitted, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        message_id, part = key
        progress = self.progress.get()
        self.progress.clear()
        if progress and not progress[3]:
            self.chunks.clear()
            yield pd.DataFrame({"message_id": [message_id], "part": [part], "content": [None], "final": [False], "expired": [True]})

    def close(self) -> None:
        pass


def stream_fold_chunks(events: DataFrame, filtered: bool = False, part_chunks: int = PART_CHUNKS,
                       late: str = "10 minutes") -> DataFrame:
    """Streaming (message_id, seq, chunk, done, ts) → finished parts (message_id, part, content, final, expired).

    Sequence numbers count from 0; the ``done`` event takes the number after the
    last chunk. A part covers ``part_chunks`` numbers and is emitted once, when all
    of them, or all up to the end, are there, in whatever order and however often
    they came; a message is complete with its ``final`` part. State is bounded by
    the part, and what is written to it by the events that are new. A part still
    unfinished ``late`` after its last event is emitted once as ``expired``,
    without content: its message is broken off, and the parts that came before are
    not to be used. A null chunk is empty. ``filtered`` drops chunks like
    :func:`~foliotree.operators.answers.filter_chunks`. See :func:`finished_messages`.
    """
    kept = F.when(F.coalesce("done", F.lit(False)), F.lit("")).otherwise(
        F.when(kept_chunk(F.col("chunk")), F.col("chunk")).otherwise(F.lit("")) if filtered else F.col("chunk")
    )
    rows = events.withWatermark("ts", late).select(
        F.col("message_id").cast("string").alias("message_id"),
        F.floor(F.col("seq") / part_chunks).cast("int").alias("part"),
        F.col("seq").cast("int").alias("seq"), F.coalesce(kept, F.lit("")).alias("chunk"), F.coalesce("done", F.lit(False)).alias("done"), "ts",
    )
    keep_state_in_rocksdb(events.sparkSession)
    return rows.groupBy("message_id", "part").transformWithStateInPandas(FoldPart(part_chunks), FOLDED, "append", "eventTime")


def finished_messages(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages (message_id, content), broken-off ones (message_id, error_message)) of the stored parts of a stream.

    A message is finished when its final part and all before it are there. One
    with an expired part is broken off; one that is merely unfinished is in neither.
    """
    state = parts.groupBy("message_id").agg(
        F.max(F.when(F.col("final"), F.col("part"))).alias("last"), F.count(F.when(~F.col("expired"), 1)).alias("n"),
        F.max("expired").alias("expired"),
    )
    whole = state.where((F.col("n") == F.col("last") + 1) & ~F.col("expired")).select("message_id")
    broken = state.where("expired").select("message_id", F.lit("the answer broke off").alias("error_message"))
    return join_parts(parts.join(whole, "message_id", "left_semi")), broken
