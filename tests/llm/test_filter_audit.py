"""The filter audit and its tries against direct versions."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from docflow.llm.filter_audit import audit
from docflow.llm.scratch import scratch_dir
from docflow.llm.text_trie import Trie, copy_flags, prefix_borders, shared

SCHEMA = "doc_id long, text string, source string, words string, mask int"


def brute(rows, labels):
    least: dict[str, int] = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    found = []
    for i, t, part, *_ in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        found.append((part or "", {c for c, f in fails.items() if f}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in found}:
        own = [f for f in found if f[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(c in f[1] for f in own) - len(gone), sum(f[1] == {c} for f in own),
                                          sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def random_rows(n: int, seed: int = 5):
    rng = random.Random(seed)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a", "ab", "abc", "AB C", "x # y", long, long + " $", long + " z", "é" * 9, "same " * 260, long.upper(), "日本" * 200 + "a", "日本" * 200 + "b"]
    return [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s1", "s2", None, ""]), "w", k) for k in range(n)]


@pytest.mark.parametrize("range_bytes", [1 << 20, 64])
def test_equals_a_direct_version(spark, range_bytes):
    rows = random_rows(300)
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, 0, 1), (99, 1, 1), (None, 1, 1), (4, None, None)]
    found = audit(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), range_bytes=range_bytes)
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in found.collect()} == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).collect() == []
    one = audit(spark.createDataFrame([(1, None, None, "", 0)], SCHEMA), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}


def test_hot_text_and_full_tries(spark):
    text = "the same beginning of a text " * 300
    rows = [(k, text + str(k % 7 if k % 3 else ""), "p") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(6)
    found = copy_flags(docs, ["part"], scratch_dir(spark), range_bytes=20_000, local_bytes=30_000).collect()
    first: dict[str, int] = {}
    for k, t, _ in rows:
        first.setdefault(t, k)
    assert sorted((r.doc_id, r.copy) for r in found) == [(k, k != first[t]) for k, t, _ in rows] and {r.n for r in found} == {1}


def test_borders_lengthen_heavy_prefixes(spark):
    rows = [("common beginning " * 5 + f"{k:04}" + "x" * 200,) for k in range(400)] + [(f"{k}",) for k in range(50)]
    borders = prefix_borders(spark.createDataFrame(rows, "text string").select(F.col("text")), scratch_dir(spark), range_bytes=10_000)
    assert borders == sorted(set(borders)) and max(map(len, borders)) > 85 and len(borders) < 200
    sizes = Counter()
    for (t,) in rows:
        sizes[sum(b <= t.encode() for b in borders)] += len(t)
    assert max(sizes.values()) < 30_000


def test_trie_keeps_texts_and_least_ids():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abé", k=rng.randint(0, 8))).encode() for _ in range(2000)]
    trie, copies = Trie(), []
    for k in rng.sample(range(2000), 2000):
        copies += trie.insert(texts[k], k, (), 1)
    ends = {t: n.least for t, n in trie.terminals()}
    assert ends == {t: texts.index(t) for t in set(texts)}
    assert sorted(i for i, _, _ in copies) == sorted(set(range(2000)) - set(ends.values()))
    assert shared(b"abcd", b"xabce", 1) == 3 and shared(b"abcd", b"abcd", 0) == 4
