"""Packing against a direct scan, in one block and across many."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.functions.text import _word_count, _word_tokens, join_tokens, register_bpe, register_encoding, token_count, token_slices, tokens
from docflow.operators import chunking as K
from docflow.schemas import as_chunks


def pack(counts, limit, overlap):
    """Token ranges of a plain left-to-right scan."""
    out, buffer, pos = [], [], 0

    def close():
        nonlocal buffer
        if buffer:
            out.append((buffer[0], buffer[-1] + 1))
            buffer = buffer[-overlap:] if overlap else []

    for n in counts:
        toks = list(range(pos, pos + n))
        pos += n
        if n > limit:
            close()
            at = 0
            while True:
                part = toks[at:at + limit]
                out.append((part[0], part[-1] + 1))
                buffer = part[-overlap:] if overlap else []
                if at + limit >= n:
                    break
                at += limit - overlap
        else:
            if len(buffer) + n > limit:
                close()
            buffer += toks
    close()
    return out


def corpus(seed, docs=30):
    rnd = random.Random(seed)
    return {str(d): [rnd.choice([0, 1, 2, 3, 5, 9, 14, 25, 60]) for _ in range(rnd.choice([0, 1, 3, 20, 60]))] for d in range(docs)}


@pytest.mark.parametrize("limit,overlap", [(10, 0), (10, 3), (7, 6), (20, 5)])
@pytest.mark.parametrize("block", [4096, 4])
def test_merge_matches_scan(spark, limit, overlap, block):
    docs = corpus(limit * 100 + overlap)
    text = lambda i, n: " ".join(f"w{i}_{j}" for j in range(n))
    rows = [(d, "g", i, text(i, n)) for d, counts in docs.items() for i, n in enumerate(counts)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_group string, chunk_idx int, content string")
    got = {}
    for r in K.merge_chunks(df, limit, "g", overlap_tokens=overlap, block=block).collect():
        got.setdefault(r.doc_id, {})[r.chunk_idx] = (r.content, r.n_tokens)
        assert r.chunk_id == f"{r.doc_id}/g:merged({limit},words)@{r.chunk_idx}" and r.parent == r.doc_id
    for d, counts in docs.items():
        stream = [(" " if j else "") + f"w{i}_{j}" for i, n in enumerate(counts) for j in range(n)]
        want = {k: ("".join(stream[a:b]), b - a) for k, (a, b) in enumerate(pack(counts, limit, overlap))}
        assert got.get(d, {}) == want
        if not overlap:
            assert "".join(t for _, (t, _n) in sorted(got.get(d, {}).items())) == "".join(stream)
            assert all(n <= limit for _, n in got.get(d, {}).values())


def test_one_hot_document(spark):
    """Nearly all chunks in one document: blocks, not documents, bound a task's group."""
    df = spark.range(20_000).select(F.lit("hot").alias("doc_id"), F.lit("g").alias("chunk_group"), F.col("id").cast("int").alias("chunk_idx"),
                                    F.array_join(F.array_repeat(F.concat(F.lit("w"), F.col("id").cast("string")), (F.col("id") % 7).cast("int")), " ").alias("content"))
    got = sorted((r.chunk_idx, r.n_tokens) for r in K.merge_chunks(df, 50, "g", block=256).collect())
    want = [(k, b - a) for k, (a, b) in enumerate(pack([i % 7 for i in range(20_000)], 50, 0))]
    assert got == want


def test_split_keeps_fitting_chunks(spark):
    rows = [("d", "g", 0, "a b c", '{"k":1}', "{}"), ("d", "g", 1, "a b c d e f g", '{"k":2}', None), ("d", "g", 2, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_group string, chunk_idx int, content string, metadata string, annotations string")
    out = K.split_oversized(df, 3, "g").orderBy("chunk_idx").collect()
    assert [(r.content, r.n_tokens, r.metadata) for r in out] == [
        ("a b c", 3, '{"k":1}'), ("a b c", 3, None), (" d e f", 3, None), (" g", 1, None), ("", 0, None)]
    assert out[0].chunk_id == "d/g:splitOversized(3,words)@0"


def test_bad_arguments(spark):
    df = spark.createDataFrame([], "doc_id string, chunk_group string, chunk_idx int, content string")
    for kw in ({"max_tokens": 0}, {"max_tokens": 5, "overlap_tokens": 5}):
        with pytest.raises(ValueError):
            K.merge_chunks(df, group="g", **kw)
    with pytest.raises(ValueError):
        K.chunking_job(df, df, "by_page", 5)


def test_custom_encoding(spark):
    register_encoding("chars", lambda c: F.length(c), lambda c: F.split(c, ""))
    df = spark.createDataFrame([("d", "g", 0, "abcdef"), ("d", "g", 1, "gh")], "doc_id string, chunk_group string, chunk_idx int, content string")
    out = K.merge_chunks(df, 4, "g", "chars").orderBy("chunk_idx").collect()
    assert [r.content for r in out] == ["abcd", "ef", "gh"] or [r.content for r in out] == ["abcd", "efgh"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\x0b  aé€😀.", max_size=12), min_size=1, max_size=40))
def test_tokens_restore_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", join_tokens(tokens(F.col("t"))).alias("back"), F.size(_word_tokens(F.col("t"))).alias("n"), token_count(F.col("t")).alias("k")).collect()
    assert all(r.t == r.back and r.n == r.k for r in rows)
    assert _word_count is not None


def test_merge_on_sparse_index(spark):
    """An index with holes, wider than a block of the scan, packs as the dense one does."""
    rows = [("d", "g", i * 5000, f"d/{i}", "a b c") for i in range(3)] + [("e", "g", i * 7, f"e/{i}", f"w{i} x") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id string, chunk_group string, chunk_idx int, chunk_id string, content string")
    from docflow.schemas import as_chunks
    out = K.merge_chunks(as_chunks(frame), max_tokens=5, group="g", new_group="m", block=16).where("chunk_group = 'm'")
    got = {}
    for r in out.orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert got["d"] == [3, 3, 3] and got["e"] == [4] * 20


def test_merge_by_byte_pairs(spark):
    """Byte-pair tokens may end inside a character; both sides of such a cut read U+FFFD."""
    import base64

    import public_tokenizers
    import tiktoken

    from docflow.functions.text import register_tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    register_tiktoken("bpe", path, public_tokenizers.PATTERN)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {"a": ["\U0001f600\U0001d6fc\u65e5\u672c", "", "plain words here", "\u00e9\u00e8 \U0001f469\u200d\U0001f469"], "b": ["x"], "c": ["\U0001f9ff" * 9]}
    rows = spark.createDataFrame([(d, "g", i, t) for d, ts in texts.items() for i, t in enumerate(ts)],
                                 "doc_id string, chunk_group string, chunk_idx int, content string")
    for limit in (1, 2, 5, 100):
        want = {}
        for doc, parts in texts.items():
            out, buffer, size = [], "", 0
            for t in parts:
                ids = enc.encode_ordinary(t)
                if len(ids) > limit:
                    if size:
                        out.append((buffer, size))
                    out += [(enc.decode(ids[k:k + limit]), len(ids[k:k + limit])) for k in range(0, len(ids), limit)]
                    buffer, size = "", 0
                elif size + len(ids) > limit:
                    out.append((buffer, size))
                    buffer, size = t, len(ids)
                else:
                    buffer, size = buffer + t, size + len(ids)
            want[doc] = out + ([(buffer, size)] if size else [])
        got = {}
        for r in K.merge_chunks(as_chunks(rows), limit, "g", "bpe").orderBy("chunk_idx").collect():
            got.setdefault(r.doc_id, []).append((r.content, r.n_tokens))
        assert got == want


@pytest.mark.parametrize("overlap", [0, 3])
def test_states_of_many_blocks_in_many_groups(spark, monkeypatch, overlap):
    """One document of many blocks, composed in groups of four, beside short ones."""
    monkeypatch.setattr(K, "AT_ONCE", 4)
    rng = random.Random(3)
    sizes = {"hot": [rng.choice([0, 1, 2, 3, 9, 30]) for _ in range(400)], "one": [2], "two": [1] * 20}
    rows = [(d, "g", i + (100 if d == "two" and i > 9 else 0), " w" * n) for d, ns in sizes.items() for i, n in enumerate(ns)]
    df = as_chunks(spark.createDataFrame(rows, "doc_id string, chunk_group string, chunk_idx int, content string"))
    got = {}
    for r in K.merge_chunks(df, 10, "g", overlap_tokens=overlap, block=4).orderBy("chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert got == {d: [hi - lo for lo, hi in pack(ns, 10, overlap)] for d, ns in sizes.items()}


def test_one_value_in_all_rows_is_dealt(spark):
    from docflow.operators.ordering import dense_index, tie_safe_ranges
    df = spark.range(4000).select(F.col("id"), F.lit("k").alias("k"), F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).cast("int").alias("o"))
    sizes = sorted(r["count"] for r in tie_safe_ranges(df, "o", 16).groupBy("_blk").count().collect())
    assert len(sizes) >= 14 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    rows = dense_index(df, ["k"], "o", "i", parts=16).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(4000)) and [r.o for r in rows] == sorted(r.o for r in rows)


def test_slices_of_byte_pairs_are_those_of_their_tokens(spark):
    """Only texts that are cut reach the encoder, and no token comes back as a value of its own."""
    class Bytes:
        encode = staticmethod(lambda text: [1000 + 1 / 0] if text.startswith("whole") else list(text.encode()))
        decode_single_token_bytes = staticmethod(lambda i: bytes([i]))

    register_bpe("slices_of_bytes", lambda: Bytes)
    texts = ["aé\U0001f600b", "", None, "xyz" * 20]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn(
        "r", F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in ((0, 2), (2, 5), (5, 90))]))
    direct = F.transform("r", lambda r: F.make_valid_utf8(F.substring(F.encode("t", "UTF-8"), (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")).cast("string")))
    for got, want in rows.select(token_slices(F.col("t"), F.col("r"), "slices_of_bytes"), F.when(F.col("t").isNotNull(), direct)).collect():
        assert got == want
    pieces = F.array(F.struct(F.lit(0).cast("long").alias("out"), F.lit(0).cast("long").alias("lo"), F.lit(7).cast("long").alias("hi")))
    whole = spark.createDataFrame([("whole 1",)], "t string").select(K._cut(F.col("t"), pieces, F.lit(7).cast("long"), "slices_of_bytes").alias("c"))
    assert [tuple(x) for x in whole.first().c] == [(0, 7, "whole 1")]
