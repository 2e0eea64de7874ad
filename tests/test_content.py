"""Resolution, combination, groups, extraction: the corners SQL checks do not reach."""

import json

from pyspark.sql import functions as F

from docflow.functions.jsonx import delta_text, normalize_vision_reply
from docflow.functions.text import fence_attachment, redact
from docflow.operators import content as C
from docflow.operators.ordering import concat_ordered, dense_index, last_before, running_before, with_frames
from docflow.plans.summarize import set_annotation
from docflow.schemas import as_chunks, as_docs


def docs(spark, *rows):
    return as_docs(spark.createDataFrame(list(rows), "doc_id string, content string, content_chunk_group string, metadata string, annotations string"))


def chunks(spark, *rows):
    return as_chunks(spark.createDataFrame(list(rows), "doc_id string, chunk_group string, chunk_idx int, content string, start int, length int"))


def test_precedence(spark):
    d = docs(spark, ("own", "", "g", None, None), ("grp", None, "g", None, None), ("none", None, None, None, None), ("gone", None, "x", None, None))
    c = chunks(spark, ("own", "g", 0, "zzz", None, None), ("grp", "g", 1, "b", None, None), ("grp", "g", 0, "a", None, None), ("grp", "s", 0, None, 1, 1),
               ("grp", "s", 1, None, 1, 5), ("grp", "s", 2, None, 2, 0), ("none", "s", 0, None, 0, 0), ("none", "s", 1, None, None, None), ("lost", "s", 0, None, 0, 1))
    whole, parts = C.resolve_content(d, c)
    assert {r.doc_id: r.content for r in whole.collect()} == {"own": "", "grp": "ab", "none": "", "gone": ""}
    got = {(r.doc_id, r.chunk_group, r.chunk_idx): (r.content, r.reason) for r in parts.collect()}
    assert got[("grp", "s", 0)] == ("b", None)
    assert got[("grp", "s", 1)] == (None, "span_out_of_range")
    assert got[("grp", "s", 2)] == ("", None) and got[("none", "s", 0)] == ("", None) and got[("none", "s", 1)] == ("", None)
    assert got[("lost", "s", 0)][1] == "span_out_of_range"


def test_spans_across_segments(spark):
    text = "".join(chr(97 + i % 26) for i in range(100))
    parents = spark.createDataFrame([("p", text)], "pid string, text string")
    spans = [(i, "p", s, n) for i, (s, n) in enumerate([(0, 100), (7, 1), (6, 2), (14, 7), (99, 1), (100, 0), (0, 0), (98, 3), (-1, 2)])]
    df = spark.createDataFrame(spans, "k int, pid string, start int, length int")
    got = {r.k: r.text for r in C.cut_spans(C.rope_of_cells(parents, "pid", segment=7), df, ["k"], "pid", segment=7).collect()}
    assert got == {k: (text[s:s + n] if s >= 0 and s + n <= 100 else None) for k, _, s, n in spans}


def test_nested_and_cycles(spark):
    rows = [("top", None, None, None, None, None, None, "a"), ("x", "top", "a", 0, None, None, None, "b"), ("y", "x", "b", 0, "hello ", None, None, None),
            ("z", "x", "b", 1, "world", None, None, None), ("s", "top", "q", 0, None, 6, 5, None), ("t", "s", "q", 0, None, 0, 2, None),
            ("loop", None, None, None, None, None, None, "c"), ("in", "loop", "c", 0, None, 0, 1, None), ("far", "top", "q", 1, None, 9, 9, None),
            ("orphan", "missing", "q", 0, None, 0, 1, None), ("hollow", None, None, None, None, None, None, "none")]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, chunk_group string, idx int, content string, start int, length int, content_chunk_group string")
    texts, rejects = C.resolve_nested(df)
    got = {r.node_id: r.text for r in texts.collect()}
    assert got == {"top": "hello world", "x": "hello world", "y": "hello ", "z": "world", "s": "world", "t": "wo", "hollow": ""}
    assert {r.node_id: r.reason for r in rejects.collect()} == {"loop": "unresolvable", "in": "unresolvable", "far": "span_out_of_range", "orphan": "unresolvable"}


def test_combine(spark):
    df = spark.createDataFrame([("a", "s1", 2), ("b", "s1", 1), ("s2x", "s2", 5), ("c", "s3", 1), ("d", "s3", 2)], "doc_id string, src string, n int")
    masters, members = C.combine_documents(df, "src", "n")
    key = {s: __import__("hashlib").sha256(s.encode()).hexdigest() for s in ("s1", "s2", "s3")}
    assert {(r.doc_id, r.joined_id) for r in masters.collect()} == {(key["s1"], "b:a"), (key["s2"], "s2x"), (key["s3"], "c:d")}
    assert {(r.master_id, r.child_id, r.chunk_idx) for r in members.collect()} == {
        (key["s1"], "b", 0), (key["s1"], "a", 1), (key["s2"], "s2x_child", 0), (key["s3"], "c", 0), (key["s3"], "d", 1)}
    whole = C.resolve_docs(as_docs(masters), C.member_chunks(members.withColumn("content", F.col("doc_id"))))
    assert {r.doc_id: r.content for r in whole.collect()} == {key["s1"]: "ba", key["s2"]: "s2x", key["s3"]: "cd"}
    named = df.withColumn("m", F.concat(F.lit("M-"), "src"))
    assert {r.doc_id for r in C.combine_documents(named, "src", "n", master_id="m")[0].collect()} == {"M-s1", "M-s2", "M-s3"}


def test_markdown_metadata(spark):
    d = docs(spark, ("own", " text \n", None, '{"b":null,"a":{"x":1}}', None), ("grp", None, "g", '{"t":"no"}', None))
    c = chunks(spark, ("grp", "g", 0, "one", None, None), ("grp", "g", 1, "two", None, None)).withColumn("metadata", F.lit('{"page":1}'))
    got = {r.doc_id: r.markdown for r in C.extract_markdown(d, c, include_metadata=True).collect()}
    assert got == {"own": '<!-- b: null -->\n<!-- a: {"x":1} -->\n text', "grp": "<!-- page: 1 -->\none\n<!-- page: 1 -->\ntwo"}


def test_summary_shapes(spark):
    shapes = {"array": (["x", '{"delta":"d"}', {"delta": "e"}, "  "], "x\n\n--\n\nd\n\n--\n\ne"), "delta": ({"delta": "d"}, "d"),
              "object": ({"b": [1, {}], "a": "é"}, '{\n  "b": [\n    1,\n    {}\n  ],\n  "a": "é"\n}'), "string": ("s", "s"), "number": (7, "7"), "null": (None, None)}
    rows = [(k, None, None, None, json.dumps({"summary": v}, ensure_ascii=False)) for k, (v, _) in shapes.items()]
    got = {r.doc_id: (r.summary, r.message) for r in C.extract_summary(docs(spark, *rows, ("none", None, None, None, "{}"), ("bare", None, None, None, None))).collect()}
    for k, (_, want) in shapes.items():
        assert got[k] == (want, None)
    assert got["none"] == got["bare"] == (None, "No summary found in annotations")


def test_delta_text(spark):
    cases = {'{"delta":"x"}': "x", '{"delta":5}': '{"delta":5}', '"q"': "q", "plain": "plain", "null": "null", '{ "b":1, "a":[2] }': '{"b":1,"a":[2]}', "7": "7"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", delta_text(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases


def test_vision_reply(spark):
    cases = {'{"markdown":"m","isFirstPage":true,"description":"d","tags":["a"]}': ("m", True, "d", ["a"]), "not json": ("not json", False, "", None),
             '```json\n{"markdown":5,"isFirstPage":"yes","tags":"a"}\n```': ("5", False, "", None), '{"isFirstPage":false}': ("", False, "", None)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", normalize_vision_reply(F.col("t")).alias("r")).collect()
    assert {r.t: (r.r.markdown, r.r.is_first_page, r.r.description, r.r.tags) for r in rows} == cases


def test_fence_and_redact(spark):
    row = spark.createDataFrame([("f.md", "a\n````b", "data:image/png;base64,AAAA", "x" * 300)], "name string, md string, url string, long string")
    assert row.select(fence_attachment(F.col("name"), F.col("md")).alias("o")).first().o == "\n\n# File attached: f.md\n`````\na\n````b\n`````"
    r = redact(row).first()
    assert r.url == "[DATA_URL length=26]" and r.long == "x" * 200 + "...[truncated]"


def test_set_annotation(spark):
    df = spark.createDataFrame([('{"a":{"y":1,"x":"q"},"s":"t","summary":1}',), (None,)], "a string")
    got = [json.loads(r.o) for r in df.select(set_annotation(F.col("a"), "summary", F.lit('"new"')).alias("o")).collect()]
    assert got == [{"a": {"y": 1, "x": "q"}, "s": "t", "summary": "new"}, {"summary": "new"}]


def test_blocked_order(spark):
    """Running sums, frames, last values and dense indexes in one long group."""
    n = 10_000
    df = spark.range(n).select(F.lit("d").alias("k"), F.col("id").cast("int").alias("i"), (F.col("id") % 11).alias("v"))
    sums = {r.i: r.s for r in running_before(df, ["k"], "i", {"s": F.col("v")}).collect()}
    total = 0
    for i in range(n):
        assert sums[i] == total
        total += i % 11
    framed = with_frames(df, ["k"], "i", 3, 2, {"b": (F.collect_list("i"), -3, -1), "a": (F.collect_list("i"), 1, 2)}, size=16)
    for r in framed.collect():
        assert r.b == [j for j in range(r.i - 3, r.i) if j >= 0] and r.a == [j for j in (r.i + 1, r.i + 2) if j < n]
    assert framed.count() == n
    last = last_before(df, ["k"], "i", F.when(F.col("i") % 5000 == 3, F.col("i")), "p")
    assert all(r.p == (None if r.i <= 3 else 3 if r.i <= 5003 else 5003) for r in last.collect())
    odd = df.withColumn("o", F.col("i") * 17 - 5)
    assert all(r.x == r.i for r in dense_index(odd, ["k"], "o", "x").collect())
    text = concat_ordered(df.withColumn("t", F.col("v").cast("string")), ["k"], "i", "t", ",").first().content
    assert text == ",".join(str(i % 11) for i in range(n))
    assert concat_ordered(df.withColumn("t", F.lit("x")), ["k"], "i", "t", "", limit=100).first().content is None
