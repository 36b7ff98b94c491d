import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliotree.operators.answers import fold_chunks
from foliotree.plans.indexing import build_index, parse_documents, store_index
from foliotree.schemas import CATALOG
from foliotree.streaming.chunk_stream import finished_messages, stream_fold_chunks
from foliotree.streaming.index_stream import catalog_log, current_catalog, current_index, decode_files, stream_index, stream_index_documents
from foliotree.sources.files import admit, scan_files, with_decoder_columns

T0 = datetime(2024, 1, 1)


def test_files_are_indexed_in_batches_as_at_once(spark, tmp_path):
    inbox, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    inbox.mkdir()

    def run():
        stream_index(spark, str(inbox), str(out), str(cp), max_files=2).awaitTermination()

    for i in range(3):
        (inbox / f"a{i}.txt").write_text(f"text {i} " * 700)
    (inbox / "broken.md").write_bytes(b"\xff")
    (inbox / "foreign.bin").write_bytes(b"x")
    run()
    (inbox / "late.md").write_text("# late\r\nline")
    (inbox / "sheet.pdf").write_bytes(b"%PDF")
    run()
    run()

    read = {name: spark.read.parquet(str(out / name)) for name in ("catalog", "doc_pages", "nodes", "rejected")}
    catalog = {r.name: (r.index_status, r.page_count, r.has_tree, r.error_message) for r in read["catalog"].collect()}
    assert catalog["a0.txt"] == ("ready", 2, True, None) and catalog["late.md"][:3] == ("ready", 1, True)
    assert catalog["broken.md"] == ("error", 0, False, "the file is not valid UTF-8")
    assert catalog["sheet.pdf"] == ("error", 0, False, "the file was not decoded")
    assert read["catalog"].count() == 6
    assert [r.reason for r in read["rejected"].collect()] == ["unsupported file type"]
    assert {r.batch for r in read["catalog"].select("batch").distinct().collect()} != {0}

    accepted, _ = admit(scan_files(spark, str(inbox)))
    whole = build_index(*decode_files(accepted))
    for name, df in whole.tables().items():
        if name in ("doc_pages", "nodes"):
            assert sorted(map(repr, df.collect())) == sorted(map(repr, read[name].drop("batch").select(*df.columns).collect()))


def test_a_batch_without_any_admitted_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "foreign.bin").write_bytes(b"x")
    stream_index(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).count() == 1
    assert spark.read.schema(CATALOG).parquet(str(tmp_path / "out" / "catalog")).count() == 0


def test_all_types_are_paged_in_one_scan(spark, tmp_path):
    schema = "doc_id int, file_type string, text string, rich_text string, raw_pages array<string>, paragraphs array<string>, error_message string"
    decoded = spark.createDataFrame([(1, ".txt", "t", None, None, None, None), (2, ".docx", None, None, None, ["d"], None)], schema)
    catalog = spark.createDataFrame([(d, f"n{d}", "pending", 0, False, None) for d in (1, 2)],
                                    "doc_id int, name string, index_status string, page_count int, has_tree boolean, error_message string")
    store_index(catalog, decoded, lambda table: str(tmp_path / table))
    assert {r.doc_id: r.index_status for r in spark.read.parquet(str(tmp_path / "catalog")).collect()} == {1: "ready", 2: "ready"}
    pages, _ = parse_documents(spark.read.schema(decoded.schema).parquet(str(tmp_path / "decoded")))
    scans = pages._jdf.queryExecution().executedPlan().toString().split("FileScan")[1:]
    assert len(scans) == 1 and re.search(r"PartitionFilters: \[[^\]]*file_type", scans[0])


def events(spark, rows):
    return spark.createDataFrame(
        [(m, s, c, d, T0 + timedelta(seconds=t)) for m, s, c, d, t in rows],
        "message_id string, seq int, chunk string, done boolean, ts timestamp",
    )


def run_fold(spark, batches, folder, **options):
    source = folder / "events"
    schema = events(spark, []).schema
    for i, batch in enumerate(batches):
        events(spark, batch).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        stream_fold_chunks(stream, **options).writeStream.format("parquet").option("path", str(folder / "out")).option(
            "checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(folder / "out")).select("message_id", "part", "content", "final", "expired").collect()))


MESSAGE = ["Hel", "lo ", "<think>", "  ", "w</think>x", "!"]


def whole(name, texts, t=0):
    return [(name, i, c, False, t + i) for i, c in enumerate(texts)] + [(name, len(texts), None, True, t + len(texts))]


def test_chunks_fold_out_of_order_and_replayed(spark, tmp_path):
    rows = whole("m", MESSAGE) + whole("n", ["only"])
    batches = [rows[4:6] + rows[7:8], rows[:2] + rows[4:5], rows[2:4] + rows[6:7], rows[:3] + rows[7:9], rows[6:]]
    got = run_fold(spark, batches, tmp_path, filtered=True)
    assert got == [("m", 0, "Hello !", True, False), ("n", 0, "only", True, False)]


def test_unfinished_messages_are_not_emitted_and_parts_are(spark, tmp_path):
    rows = whole("m", list("abcdefg"))
    open_end = [("u", 0, "x", False, 0)]
    got = run_fold(spark, [rows[:5] + open_end, rows[5:]], tmp_path, part_chunks=3)
    assert got == [("m", 0, "abc", False, False), ("m", 1, "def", False, False), ("m", 2, "g", True, False)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [r for k in range(20) for r in whole(f"m{k}", [f"{k}.{i} " for i in range(k)])]
    got = run_fold(spark, [rows[::3], rows[1::3], rows[2::3]], tmp_path, part_chunks=8)
    chunks = events(spark, rows).where(~F.col("done"))
    batch = {r.message_id: r.content for r in fold_chunks(chunks, part_chunks=8).collect()}
    finished, broken = finished_messages(spark.read.parquet(str(tmp_path / "out")))
    assert {r.message_id: r.content for r in finished.collect() if r.content} == batch and broken.count() == 0
    assert sorted(g[0] for g in got if g[3]) == sorted(f"m{k}" for k in range(20))


def test_state_of_abandoned_messages_goes(spark, tmp_path):
    first = [("u", 0, "x", False, 0)]
    later = whole("m", ["a"], t=4000)
    last = whole("n", ["b"], t=9000)
    # The end of u comes after its part was given up, which was said.
    got = run_fold(spark, [first, later, last, [("u", 1, None, True, 1)]], tmp_path, late="1 minute")
    assert got == [("m", 0, "a", True, False), ("n", 0, "b", True, False), ("u", 0, None, False, True)]
    finished, broken = finished_messages(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(r.message_id for r in finished.collect()) == ["m", "n"] and [r.message_id for r in broken.collect()] == ["u"]


def documents_of(spark, batch):
    none = F.lit(None).cast("string").alias("error_message")
    fresh = batch.select("doc_id", F.col("doc_id").cast("string").alias("name"), F.lit("pending").alias("index_status"), F.lit(0).alias("page_count"),
                         F.lit(False).alias("has_tree"), none)
    return fresh, with_decoder_columns(batch.select("doc_id", "file_type", "text", none))


def test_one_current_row_per_document(spark, tmp_path):
    """Documents that come again replace their pages; one that fails later keeps what it had; a batch that breaks off is made again."""
    schema = "doc_id long, text string, file_type string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    broken = []

    def decode(batch):
        if broken and broken.pop():
            raise RuntimeError("the driver dies")
        return documents_of(spark, batch)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        return stream_index_documents(spark.readStream.schema(schema).parquet(source), decode, out, checkpoint, compact_every=2)

    arrive([(1, "a" * 3500, ".txt"), (2, "b", ".txt"), (3, "c", ".bin")]).awaitTermination()
    state = lambda: {r.doc_id: (r.index_status, r.page_count, r.has_tree, r.index_batch) for r in current_catalog(spark, out).collect()}
    assert state() == {1: ("ready", 2, True, 0), 2: ("ready", 1, True, 0), 3: ("error", 0, False, None)}
    broken.append(True)
    second = arrive([(1, "z", ".txt"), (2, "x", ".bin"), (4, "d", ".txt")])
    try:
        second.awaitTermination()
    except Exception:
        pass
    assert state()[1] == ("ready", 2, True, 0) and 4 not in state()
    arrive([(5, "e", ".txt")]).awaitTermination()
    assert state() == {1: ("ready", 1, True, 1), 2: ("error", 1, True, 0), 3: ("error", 0, False, None), 4: ("ready", 1, True, 1), 5: ("ready", 1, True, 2)}
    index = current_index(spark, out)
    assert sorted((r.doc_id, r.content) for r in index.doc_pages.collect()) == [(1, "z"), (2, "b"), (4, "d"), (5, "e")]
    assert sorted({r.doc_id for r in index.nodes.collect()}) == [1, 2, 4, 5] and index.page_summaries.count() == 4
    assert len(catalog_log(spark, out).live()) == 3  # a compacted one and the two of the last batch


def test_status_while_a_batch_is_indexed(spark, tmp_path):
    schema, out = "doc_id long, text string, file_type string", str(tmp_path / "out")
    seen = []

    class Watching:
        def attach(self, requests):
            seen.append({r.doc_id: r.index_status for r in current_catalog(spark, out).collect()})
            return requests.drop("system", "prompt").withColumn("response", F.lit(None).cast("string"))

    spark.createDataFrame([(1, "some text " * 40, ".txt")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream_index_documents(stream, lambda b: documents_of(spark, b), out, str(tmp_path / "cp"), Watching()).awaitTermination()
    assert seen and seen[0] == {1: "indexing"}
    assert [r.index_status for r in current_catalog(spark, out).collect()] == ["ready"]


class FakeHandle:
    """State of one key in memory, with what is written to it."""

    def __init__(self):
        self.appended, self.updates, self.timers, self.value = [], 0, set(), None

    def getListState(self, *_):
        outer = self

        class Listed:
            def appendList(self, rows):
                outer.appended += rows

            def get(self):
                return iter(outer.appended)

            def clear(self):
                outer.cleared = True
        return Listed()

    def getValueState(self, *_):
        outer = self

        class Value:
            def get(self):
                return outer.value

            def update(self, value):
                outer.value = value
                outer.updates += 1
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_an_event_writes_itself_only():
    """Of a part of 4,096 chunks in 400 batches, each with replays, every chunk is written once; beside it there are 512 bytes."""
    import random

    import pandas as pd

    from foliotree.streaming.chunk_stream import FoldPart

    class Values:
        def getCurrentWatermarkInMs(self):
            return 0

    handle, fold, draw = FakeHandle(), FoldPart(4096), random.Random(1)
    fold.init(handle)
    order = draw.sample(range(4096), 4096)
    out = []
    for k in range(0, 4096, 11):
        seqs = order[k : k + 11] + draw.sample(order[: k + 1], min(5, k + 1))
        batch = pd.DataFrame({"seq": seqs, "chunk": [f"{s} " for s in seqs], "done": False, "ts": pd.Timestamp(T0 + timedelta(seconds=k))})
        out += list(fold.handleInputRows(("m", 0), iter([batch]), Values()))
        assert len(handle.value[0]) <= 512 and len(handle.timers) == 1
    assert sorted(s for s, _ in handle.appended) == list(range(4096)) and handle.cleared
    assert len(out) == 1 and out[0]["content"][0] == "".join(f"{s} " for s in range(4096))


def test_a_part_that_comes_at_once_has_no_list():
    """Its events never go to the state and back; those of a part that comes in two calls do."""
    import pandas as pd

    from foliotree.streaming.chunk_stream import FoldPart

    class Values:
        def getCurrentWatermarkInMs(self):
            return 0

    def folded(*calls):
        handle, fold = FakeHandle(), FoldPart(4)
        fold.init(handle)
        used = []
        for name in ("appendList", "get", "clear"):
            whole = getattr(fold.chunks, name)
            setattr(fold.chunks, name, lambda *a, name=name, whole=whole: (used.append(name), whole(*a))[1])
        rows = [r for call in calls for r in fold.handleInputRows(("m", 1), iter([
            pd.DataFrame({"seq": [s], "chunk": [f"c{s}"], "done": [False], "ts": pd.to_datetime([s], unit="s")}) for s in call]), Values())]
        return [r["content"][0] for r in rows], used

    assert folded([5, 4, 7, 5, 6], [6, 4]) == (["c4c5c6c7"], [])
    assert folded([5, 4], [7, 5, 6], [6, 4]) == (["c4c5c6c7"], ["appendList", "appendList", "get", "clear"])
