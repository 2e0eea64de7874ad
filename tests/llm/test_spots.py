"""Fingerprints from spots against direct versions."""

from __future__ import annotations

import random
import re
from itertools import islice

import pytest
from pyspark.sql import functions as F

from docflow.llm.spots import ANCHORS, edited_pairs, fingerprint, likeness, near_matches, signatures

COMMON = set(ANCHORS)
WORDS = ["the", "of", "la", "Der", "und", "a", "cat", "dog", "été", "fish", "x1", "bird", "日本", "house", "tree", "road"]


def direct(text: str | None) -> set[tuple]:
    """Signatures as tuples of words."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    out = set()
    for i, w in enumerate([None, *words]):
        if w is None or w in COMMON:
            chain = list(islice((x for x in words[i:i + 200] if x not in COMMON), 2))
            if chain:
                out.add((w, *chain))
    return out


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def random_texts(n: int, seed: int = 2) -> list[str | None]:
    rng = random.Random(seed)
    return [rng.choice([None, "", "...", "the of", " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))]) if k % 4 == 0
            else rng.choice([" ", ", ", ".\n"]).join(rng.choices(WORDS, k=rng.randint(1, 60))) for k in range(n)]


def test_signatures(spark):
    texts = random_texts(200)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", "t", signatures(F.col("t")).alias("s")).collect()
    assert [len(r.s) for r in rows] == [len(direct(r.t)) for r in rows] and all(list(r.s) == sorted(set(r.s)) for r in rows)
    for r, q in zip(rows, rows[1:]):        # the same tuples are the same hashes
        assert len(set(r.s) & set(q.s)) == len(direct(r.t) & direct(q.t))


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_edited_texts_and_likeness(spark, partitions):
    texts = random_texts(150)
    ids = random.Random(1).sample(range(-500, 5000), 149) + [None]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame([(i, t, 9) for i, t in zip(ids, texts)], "doc_id long, text string, part int").repartition(5)
        rows = {r.doc_id: r for r in edited_pairs(docs).select("*", likeness(F.col("signatures"), F.col("edited_signatures")).alias("e"),
                                                              likeness(F.col("signatures"), F.col("next_signatures")).alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(rows) == len(order)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        assert (rows[i].n_chars, rows[i].edited) == (len(t), edited)
        assert rows[i].e == pytest.approx(jaccard(direct(t), direct(edited))) and rows[i].n == pytest.approx(jaccard(direct(t), direct(after)))


def test_repeated_rows_and_small_tables(spark):
    schema = "doc_id long, text string"
    assert edited_pairs(spark.createDataFrame([], schema)).collect() == []
    one = edited_pairs(spark.createDataFrame([(1, "the cat dog")], schema)).collect()
    assert [r.edited for r in one] == ["the cat the"]
    same = edited_pairs(spark.createDataFrame([(1, "abc")] * 500 + [(2, "xyz")] * 3, schema).repartition(7)).collect()
    assert sorted((r.doc_id, r.edited) for r in same) == sorted([(1, "aba")] * 499 + [(1, "abx")] + [(2, "xyx")] * 2 + [(2, "xya")])


def test_long_text(spark):
    text = " ".join(random.Random(3).choices(WORDS, k=200_000))
    row = edited_pairs(spark.createDataFrame([(1, text), (2, text), (3, "x")], "doc_id long, text string")).select(
        "doc_id", F.size("signatures").alias("n"), fingerprint(F.col("signatures")).alias("f")).collect()
    assert {r.doc_id: r.n for r in row} == {1: len(direct(text)), 2: len(direct(text)), 3: 1} and len({r.f for r in row}) == 2


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_near_matches_are_all_found(spark, least):
    rng, texts = random.Random(4), []
    for k in range(30):
        words = rng.choices(WORDS, k=40)
        for _ in range(5):
            texts.append(" ".join(words))
            words = [w if rng.random() > 0.03 else rng.choice(WORDS) for w in words]
    texts += random_texts(50) + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.query_id, r.doc_id): r.likeness for r in near_matches(docs.where("doc_id % 10 = 0"), docs, least).collect()}
    want = {(i, j): jaccard(direct(texts[i]), direct(texts[j])) for i in range(0, len(texts), 10) for j in range(len(texts)) if direct(texts[i]) and direct(texts[j])}
    assert found == pytest.approx({k: v for k, v in want.items() if v >= least}) and len(found) > 20
