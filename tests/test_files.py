from pyspark.sql import functions as F

from foliotree.sources import files, tables


def test_admission(spark, rows):
    df = spark.createDataFrame([
        ("a.TXT", 52428800), ("a.txt", 52428801), ("a.tar.gz", 1), ("a.exe", 99999999), (".pdf", 1), ("noext", 1),
    ], "name string, length long")
    accepted, rejected = files.admit(df)
    assert rows(accepted) == [("a.TXT", 52428800, ".txt")]
    assert rows(rejected, "name", "reason") == [
        (".pdf", "unsupported file type"), ("a.exe", "unsupported file type"), ("a.tar.gz", "unsupported file type"),
        ("a.txt", "file too large"), ("noext", "unsupported file type"),
    ]


def test_decode_is_strict_and_unifies_newlines(spark, rows):
    df = spark.createDataFrame([
        (1, ".txt", bytearray(b"a\r\nb\rc")), (2, ".md", bytearray(b"\xffA")), (3, ".txt", bytearray(b"")),
        (4, ".txt", bytearray(b"\xed\xa0\x80")), (5, ".pdf", bytearray(b"\xff")), (6, ".txt", bytearray("é😀".encode())),
    ], "doc_id int, file_type string, content binary")
    out = {r.doc_id: (r.text, r.error_message is not None) for r in files.decode_text(df).collect()}
    assert out == {1: ("a\nb\nc", False), 2: (None, True), 3: ("", False), 4: (None, True), 5: (None, False), 6: ("é😀", False)}


def test_scan_and_register(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b.bin").write_bytes(b"x")
    scanned = files.scan_files(spark, str(tmp_path))
    assert {(r.name, r.length) for r in scanned.select("name", "length").collect()} == {("a.txt", 5), ("b.bin", 1)}
    accepted, rejected = files.admit(scanned)
    first, second = files.register(accepted).collect(), files.register(accepted).collect()
    assert [r.doc_id for r in first] == [r.doc_id for r in second]
    row = first[0]
    assert (row.name, row.file_type, row.file_size, row.index_status, row.page_count, row.has_tree) == ("a.txt", ".txt", 5, "pending", 0, False)
    assert [r.name for r in rejected.collect()] == ["b.bin"]


def test_large_files_are_not_opened(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    accepted, _ = files.admit(files.scan_files(spark, str(tmp_path)))
    plan = accepted._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,52428800)" in plan


def test_saved_tables_come_back_clustered(spark, tmp_path):
    pages = spark.range(1000).select((F.col("id") % 50).alias("doc_id"), (F.col("id") / 50).cast("int").alias("page_number"),
                                     F.col("id").cast("string").alias("content"))
    tables.save({"doc_pages": pages}, str(tmp_path / "v1"), files=4)
    back = tables.load(spark, str(tmp_path / "v1"), "doc_pages")["doc_pages"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pages.collect()))
    plan = back.where("page_number <= 5").select("doc_id", "page_number")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(page_number,5)" in plan
    assert "ReadSchema: struct<doc_id:bigint,page_number:int>" in plan
