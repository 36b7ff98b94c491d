import json

from pyspark.sql import functions as F

from foliotree.functions import text as t


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_strip_is_pythons(spark):
    values = ["", "  a b ", " x ", "\x1cx\x1f", "　\n\t", "﻿x", "x​", None]
    assert column(spark, values, t.strip) == [v if v is None else v.strip() for v in values]


def test_file_ext(spark):
    names = ["a.TXT", "a.tar.gz", "a.exe", ".pdf", "noext", "dir.d/file", "d/.hidden", "d/x.Md", "..pdf", "a."]
    assert column(spark, names, t.file_ext) == [".txt", ".gz", ".exe", "", "", "", "", ".md", "", ""]


def test_title_is_the_stem(spark):
    paths = ["uploads/ab-cd.txt", "x/a.tar.gz", ".pdf", "noext", None]
    assert column(spark, paths, t.doc_title) == ["ab-cd", "a.tar", ".pdf", "noext", "Untitled"]


def test_think_blocks(spark):
    values = ["<think>a\nb</think> x ", "x<think>1</think>y<think>2</think>z", "<think>open", "a</think>b"]
    assert column(spark, values, t.strip_think) == ["x", "xyz", "<think>open", "a</think>b"]


def test_spans_are_greedy(spark):
    values = ['Sure: {"a": {"b": 1}}\n done', "none", "} {", "{x} y {z}"]
    assert column(spark, values, t.json_object_span) == ['{"a": {"b": 1}}', None, None, "{x} y {z}"]
    assert column(spark, ["a [1] b [2] c"], t.json_array_span) == ["[1] b [2]"]


def test_strict_json_accepts_what_python_accepts(spark):
    values = [
        "{}", "[]", '{"a":1}', '{"a":1} junk {"a":2}', '{"a":1}],[{"b":1}', "[1],[2]", "[1]]", "{", '{"a":}', "{'a':1}",
        '{"a":1,}', "[1,2,]", '{"a":"\\u00e9"}', '{"a":"\n"}', '{"a":tru}', "[null]", '{"a":1}\n', "[01]", "[1e5]", "[-0.5]",
        '["]"]', '["x\\"]', '[{"a":[1,{"b":[]}]}]', "[1] x [2]", '{"a":1}{"b":2}', '[1],"@@END@@"', '{"a" 1}', "",
    ]

    def accepted(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = t.with_strict_json(df, F.col("v"), "j").orderBy("i").select(F.col("j").isNotNull()).collect()
    # A control character inside a string and a leading zero are Python errors as well.
    assert {v: r[0] for v, r in zip(values, out)} == {v: accepted(v) for v in values}


def test_strict_json_keeps_null_apart_from_missing(spark):
    df = spark.createDataFrame([('{"a": null}',), ('{"b": 1}',)], "v string")
    v = F.try_variant_get("j", "$.a", "variant")
    out = t.with_strict_json(df, F.col("v"), "j").select(v.isNull(), t.variant_kind(v)).collect()
    assert [tuple(r) for r in out] == [(False, "VOID"), (True, None)]
