"""Token alignment against the libraries themselves, text by text."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docflow.llm import alignment
from docflow.llm.alignment import PerfectHash, align, corpus_counts, fragments_of

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "   x", "a", "a ", "a  ", "a \n b", "a\n b", "a\n\n  b ", "tab\t x\t\ty", "it's <|endoftext|> </s><s> <0x41>", "▁a b", "x ▁",
       "été naïve ﬁ é", "日本語 テキスト", "😀 👩‍👩‍👧 x😀", "a b   c", "  a 　 b", "\x00 \x1c a\x1d b", "0123 456 7.8,9", "word " * 300, "x" * 5000,
       "the the the cat", "don't we'll I'm"]


def brute(texts: dict[int, str | None]) -> dict[int, tuple]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    bytes_a = alignment.token_bytes(PATHS[0])
    plain = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    cut, counts = {}, Counter()
    for k, t in texts.items():
        whole = (" " + (t or "")).encode()
        ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)] if t else [[], []]
        data = [[bytes_a[i] for i in ids[0]], [plain(i) for i in ids[1]]]
        if not t or any(b"".join(d) != whole for d in data):
            cut[k] = [], [], [], []
            continue
        ends = [np.cumsum(list(map(len, d))).tolist() for d in data]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((ids[0][i:m], ids[1][j:n]))
            i, j = m, n
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        cut[k] = *ids, groups, links
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    text = lambda ids: ",".join(map(str, ids))
    return {k: (len(x), len(y), len(g), len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls),
                ";".join(f"{text(m)}|{text(n)}" for m, n in g)) for k, (x, y, g, ls) in cut.items()}


def found(spark, texts, **shape):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = align(docs, PATHS, corpus_counts(docs, PATHS)).collect()
    return {r[0]: tuple(r)[1:] for r in rows}


def random_texts(n: int) -> dict[int, str | None]:
    rng = random.Random(7)
    bits = ["the", " ", "  ", "\n", "ing", "Ünder", "a", "▁" * 1, "é", "日", "😀", "'s", "1", ".", ",", "\t", " ", "<s>", "x1", "tion", " of", "́"]
    weights = [1 if b == "▁" else 30 for b in bits]
    return {i: "".join(rng.choices(bits, weights, k=rng.randint(1, 40))) for i in range(n)}


def test_equals_the_libraries(spark):
    texts = {i: t for i, t in enumerate(ODD)} | {100 + k: t for k, t in random_texts(400).items()}
    assert found(spark, texts) == brute(texts)


def test_shards_leaves_and_short_memory(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD", 64)
    monkeypatch.setattr(alignment, "FAN", 2)
    texts = random_texts(300)
    assert found(spark, texts) == brute(texts)


def test_nothing_to_align(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_a string")
    assert align(docs, PATHS, corpus_counts(docs, PATHS)).collect() == []
    none = {1: None, 2: "", 3: "▁"}
    assert found(spark, none) == brute(none)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (5, "a b", 2), (5, "a b", 3), (5, "c", 4)], "doc_id long, text string, n_links int")
    rows = align(docs, PATHS, corpus_counts(docs, PATHS)).orderBy("doc_id", "n_a").collect()
    assert [r.doc_id for r in rows] == [None, 5, 5, 5] and [r.count_sum for r in rows] == [6, 1, 6, 6]


def test_counts_of_pairs(spark):
    texts = random_texts(200)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    counts = corpus_counts(docs, PATHS)
    total = counts.rows().agg(F.sum("n"), F.count("*"), F.countDistinct("a", "b")).first()
    assert total[0] == sum(v[3] for v in brute(texts).values()) and total[1] == total[2]
    # Texts that were not counted meet pairs that are not there.
    strange = align(spark.createDataFrame([(1, "Zyzzyva")], "doc_id long, text string"), PATHS, counts).first()
    assert strange.n_links > 0 and strange.count_sum == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    h = PerfectHash.of(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    assert (h.index(keys + np.uint64(1 << 63)) == -1).all()


def test_hash_of_a_pair_is_that_of_spark(spark):
    values = np.random.default_rng(3).integers(-1 << 63, (1 << 63) - 1, 50)
    rows = spark.createDataFrame([(int(v),) for v in values], "pair long").select(F.xxhash64("pair")).collect()
    assert alignment._xxhash64(values).view(np.int64).tolist() == [r[0] for r in rows]


def test_fragments_join_to_the_text():
    for t in filter(None, [*ODD, *random_texts(200).values()]):
        assert " ".join(fragments_of(t)) == t


def test_both_encoders_of_a_agree():
    aligner = alignment.Aligner(PATHS)
    words = [t.decode("utf-8", "ignore").strip(" ") for t in alignment.token_bytes(PATHS[0]).values()]
    rng = random.Random(9)
    words += ["".join(rng.choices("abcdeéßñ'.,;0123\n\tABst ll", k=rng.randint(1, 12))) for _ in range(20_000)]
    plain = [w for w in words if alignment.PLAIN.fullmatch(w)]
    assert len(plain) > 40_000 and aligner.quick is not None
    want = [e.ids for e in aligner.a.encode_batch_fast([" " + w for w in plain], add_special_tokens=False)]
    assert [aligner.quick.encode_ordinary(" " + w) for w in plain] == want
