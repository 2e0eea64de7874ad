"""Chunks of chunks as rows, and texts as ropes."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from docflow.operators import chunking as K, content as C
from docflow.operators.rope import cut_spans, one_cell, rope_of_cells, rope_of_rows, rope_sha256
from docflow.operators.tree import docs_as_nodes, node_key, nodes_as_docs, owned
from docflow.plans.prompts import with_context
from docflow.session import cut_lineage
from docflow.sinks.documents import nest_docs
from docflow.sources.docjson import parse_docs, parse_embeddings


def parsed(spark, *objects):
    docs, chunks, rejects = parse_docs(spark.createDataFrame([(json.dumps(o),) for o in objects], "json string"))
    assert rejects.count() == 0
    return docs, chunks


def page(i, text):
    return {"id": i, "content": text}


MASTER = {"id": "M", "content_chunk_group": "members", "chunks": {"members": [
    {"id": "A", "content_chunk_group": "pages", "chunks": {"pages": [page("A0", "a0 "), page("A1", "a1 ")]}},
    {"id": "B", "content_chunk_group": "pages", "chunks": {"pages": [page("B0", "b0 "), page("B1", "b1 ")]}}]}}


def test_resolve_masters_of_masters(spark):
    docs, chunks = C.resolve_content(*parsed(spark, MASTER, {"id": "F", "content": "flat", "chunks": {"s": [{"id": "s0", "start": 1, "length": 2}]}}))
    assert {r.doc_id: r.content for r in docs.collect()} == {"M": "a0 a1 b0 b1 ", "F": "flat"}
    texts = {(r.doc_id, r.owner, r.chunk_idx): r.content for r in chunks.collect()}
    assert texts["M", "", 0] == "a0 a1 " and texts["M", "", 1] == "b0 b1 " and texts["M", "members@1", 1] == "b1 " and texts["F", "", 0] == "la"


def test_spans_into_inner_nodes(spark):
    inner = {"id": "A", "content": "hello world", "chunks": {"s": [{"id": "s0", "start": 6, "length": 5}, {"id": "s1", "start": 9, "length": 9},
             {"id": "s2", "start": 0, "length": 5, "chunks": {"t": [{"id": "t0", "start": 1, "length": 3}]}}]}}
    _, chunks = C.resolve_content(*parsed(spark, {"id": "D", "content": "outer", "chunks": {"m": [inner]}}))
    got = {r.chunk_id: (r.content, r.reason) for r in chunks.collect()}
    assert got["s0"] == ("world", None) and got["s1"] == (None, "span_out_of_range") and got["t0"] == ("ell", None)


def test_groups_of_each_owner_stand_alone(spark):
    _, chunks = parsed(spark, MASTER)
    near = {r.chunk_id: (r.prev_id, r.next_id) for r in C.with_neighbors(chunks, "pages").collect()}
    assert near == {"A0": (None, "A1"), "A1": ("A0", None), "B0": (None, "B1"), "B1": ("B0", None)}
    shown = {r.chunk_id: (r.preceding, r.succeeding) for r in with_context(chunks.where("chunk_group = 'pages'"), 2, 2, wrap=False).collect()}
    assert shown["A0"] == ("", "a1 ") and shown["B1"] == ("b0 ", "")
    merged = {(r.owner, r.chunk_idx): (r.chunk_id, r.parent, r.depth, r.content) for r in K.merge_chunks(chunks, 2, "pages", new_group="w").collect()}
    # Each merged text of at most two tokens: 'a0', ' a1', ' '.
    assert {k: v[:3] for k, v in merged.items()} == {("members@0", 0): ("A/w@0", "A", 2), ("members@0", 1): ("A/w@1", "A", 2),
                                                    ("members@1", 0): ("B/w@0", "B", 2), ("members@1", 1): ("B/w@1", "B", 2)} or len(merged) == 4
    assert "".join(v[3] for k, v in sorted(merged.items())) == "a0 a1 b0 b1 "
    for overlap in (0, 1):
        whole = K.merge_chunks(chunks, 100, "pages", overlap_tokens=overlap).collect()
        assert sorted(r.content for r in whole) == ["a0 a1 ", "b0 b1 "]
    cut = K.split_oversized(chunks, 1, "pages", new_group="x").orderBy("owner", "chunk_idx").collect()
    assert [r.owner for r in cut] == sorted(r.owner for r in cut) and "".join(r.content for r in cut) == "a0 a1 b0 b1 "


def test_append_and_replace_in_inner_groups(spark):
    _, chunks = parsed(spark, MASTER)
    new = owned(spark.createDataFrame([("M", "members@1", "B", 0, "B2", "b2 ")],
                                      "doc_id string, owner string, owner_id string, chunk_idx int, chunk_id string, content string"))
    longer = C.append_to_group(chunks, "pages", new)
    assert [r.chunk_idx for r in longer.where("chunk_id = 'B2'").collect()] == [2] and longer.count() == 7
    swapped = C.replace_group(chunks, "pages", new)
    assert {r.chunk_id for r in swapped.where("chunk_group = 'pages'").collect()} == {"A0", "A1", "B2"}


def deep(level: int):
    inner = {"id": f"n{level}", "content": f"text {level}", "metadata": {"level": level}}
    if level < 20:
        inner["chunks"] = {"g/1@%": [deep(level + 1), page("same", "x")], "h": [page("same", "y")]}
    return inner


def test_parse_and_nest_give_back_the_input(spark):
    flat = {"id": "F", "content": "one", "chunks": {"a": [page("x", "1"), page("y", "2")]}}
    objects = [deep(0), MASTER, flat, {"id": "E"}]
    docs, chunks = parsed(spark, *objects)
    assert chunks.select("doc_id", "owner", "chunk_group", "chunk_idx").distinct().count() == chunks.count()

    def with_parents(o, owner=None):
        out = dict(o)
        if owner is not None:
            out["parent"] = owner
        if "chunks" in o:
            out["chunks"] = {g: [with_parents(c, o["id"]) for c in cs] for g, cs in o["chunks"].items()}
        return out

    rows = nest_docs(docs, chunks).collect()
    assert {r.doc_id: json.loads(r.json) for r in rows} == {o["id"]: with_parents(o) for o in objects}


def test_embeddings_of_inner_chunks(spark):
    inner = {"id": "A", "chunks": {"p": [{"id": "A0", "content": "t", "embeddings": {"m": [0.5, 1.0]}}]}}
    o = {"id": "D", "chunks": {"m": [inner]}}
    texts = spark.createDataFrame([(json.dumps(o),)], "json string")
    vectors = parse_embeddings(texts)
    assert [tuple(r)[:4] for r in vectors.collect()] == [("D", "m@0", "p", 0)]
    docs, chunks, _ = parse_docs(texts)
    back = json.loads(nest_docs(docs, chunks, vectors).first().json)
    assert back["chunks"]["m"][0]["chunks"]["p"][0]["embeddings"] == {"m": [0.5, 1.0]}


def test_too_large_inner_nodes(spark, tmp_path):
    docs, chunks = parsed(spark, MASTER, {"id": "S", "content": "s", "chunks": {"g": [page("x", "1")]}})
    rows = {r.doc_id: (r.json is None, r.reason) for r in nest_docs(docs, chunks, limit=80).collect()}
    assert rows == {"M": (True, "document_too_large"), "S": (False, None)}


def test_objects_in_parts(spark):
    part = 300
    wide = {"id": "W", "content_chunk_group": "a/b", "chunks": {"a/b": [{"id": f"W{i}", "content_chunk_group": "l", "metadata": {"n": i}, "chunks": {
        "l": [page(f"W{i}.{k}", f"é{i}\U0001f600{k}\n") for k in range(9 * (i % 4))]}} for i in range(12)], "c": [page("z", "z")]}}
    docs, chunks = parsed(spark, wide, MASTER, {"id": "E"}, {"id": "F", "content": "one", "chunks": {"a": [page("x", "1")]}})
    docs, chunks = cut_lineage(docs), cut_lineage(chunks)
    objects = cut_lineage(nest_docs(docs, chunks, part=part))
    rows = objects.collect()
    assert len(rows) > 20 and max(len(r.json) for r in rows) < 3 * part and {r.reason for r in rows} == {None}
    # Parts of the document and of its chunks.
    assert {json.loads(r.json).get("continues", {}).get("owner", "none") for r in rows} >= {"none", "", "a%2Fb@1"}
    back_docs, back, rejects = parse_docs(objects.select("json"))
    assert rejects.isEmpty()
    assert sorted(map(str, back_docs.collect())) == sorted(map(str, docs.collect()))
    assert sorted(map(str, back.collect())) == sorted(map(str, chunks.collect()))


def test_texts_of_documents_too_long_for_a_cell(spark):
    docs, chunks = parsed(spark, MASTER, {"id": "F", "content": "flat", "chunks": {"s": [{"id": "s0", "start": 1, "length": 2}]}})
    whole, inner = C.resolve_content(docs, chunks, doc_limit=7)
    assert {r.doc_id: (r.content, r.reason) for r in whole.collect()} == {"M": (None, "text_too_long"), "F": ("flat", None)}
    assert {r.chunk_id: r.content for r in inner.collect()}["A"] == "a0 a1 "
    assert {r.doc_id: r.sha256 for r in C.text_sha256(whole, inner).collect()} == {
        "M": hashlib.sha256(b"a0 a1 b0 b1 ").hexdigest(), "F": hashlib.sha256(b"flat").hexdigest()}


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_digests_along_ropes(spark, segment):
    texts = {f"k{i}": "aé\U0001f600\n"[:i % 5] * i for i in range(30)}
    rope = rope_of_cells(spark.createDataFrame(list(texts.items()), "k string, text string"), "k", segment=segment)
    assert {r.k: r.sha256 for r in rope_sha256(rope, "k").collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}


def test_node_keys(spark):
    rows = spark.createDataFrame([("d", "", "d"), ('["x', "", '["x'), ("d", 'g"@0/h@1', "i")], "doc_id string, owner string, owner_id string")
    assert sorted(map(tuple, docs_as_nodes(nodes_as_docs(rows)).collect())) == sorted(map(tuple, rows.collect()))
    assert rows.select(node_key(F.col("doc_id"), F.col("owner"))).distinct().count() == 3


@pytest.mark.parametrize("segment", [1, 3, 7, 1000])
def test_ropes_have_one_form(spark, segment):
    rng = random.Random(segment)
    texts = {k: ["".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 12))] for k in range(30)}
    rows = spark.createDataFrame([(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)], "k int, i int, text string").repartition(4)
    cells = spark.createDataFrame([(k, "".join(ts)) for k, ts in texts.items()], "k int, text string")
    shown = lambda rope: sorted((r.k, r.seg, r.part, r.total) for r in rope.collect())
    by_rows = rope_of_rows(rows, "k", "i", segment=segment)
    assert shown(by_rows) == shown(rope_of_cells(cells, "k", segment=segment))
    assert {r.k: r.text for r in one_cell(by_rows, "k").collect()} == {k: "".join(ts) for k, ts in texts.items()}
    long = {r.k: (r.text, r.reason) for r in one_cell(by_rows, "k", limit=10).collect()}
    assert all(long[k] == ((t, None) if len(t) <= 10 else (None, "text_too_long")) for k, t in ((k, "".join(ts)) for k, ts in texts.items()))
    joined = {r.k: r.text for r in one_cell(rope_of_rows(rows, "k", "i", separator="--", segment=segment), "k").collect()}
    assert joined == {k: "--".join(ts) for k, ts in texts.items()}
    spans = [(n, k, rng.randint(-1, 30), rng.randint(-1, 12)) for n, k in enumerate([*range(30), 99] * 4)]
    got = {r.n: (r.text, r.reason) for r in cut_spans(by_rows, spark.createDataFrame(spans, "n int, k int, start int, length int"), ["n"], "k", segment).collect()}
    for n, k, start, length in spans:
        t = "".join(texts.get(k, []))
        good = k in texts and start >= 0 and length >= 0 and start + length <= len(t)
        assert got[n] == ((t[start:start + length], None) if good else (None, "span_out_of_range"))


def test_spans_of_documents_too_long_for_a_cell(spark):
    rows = [{"id": f"p{i}", "content": f"page {i} " * 20} for i in range(40)]
    text = "".join(r["content"] for r in rows)
    o = {"id": "L", "content_chunk_group": "pages", "chunks": {"pages": rows, "s": [{"id": "s0", "start": 3000, "length": 2500}]}}
    docs, chunks = parsed(spark, o)
    whole = C.resolve_content(docs, chunks)
    short = C.resolve_content(docs, chunks, limit=1000)
    span = lambda r: [tuple(x) for x in r[1].where("chunk_id = 's0'").select("content", "reason").collect()]
    assert span(whole) == span(short) == [(text[3000:5500], None)]
    assert [(r.content, r.reason) for r in short[0].collect()] == [(None, "text_too_long")] and whole[0].first().content == text
    parts = C.resolve_parts(docs, chunks, segment=500).orderBy("seg").collect()
    assert "".join(r.part for r in parts) == text and {r.total for r in parts} == {len(text)}
