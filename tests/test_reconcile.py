"""Word alignment by its properties, and what runs and markup look like."""

import random
from bisect import bisect_left

import pytest

from docflow.operators import reconcile as R

PAIRS = "pair_id string, text_a string, text_b string"
SENTENCES = {
    "equal": ("Rain fell over the harbour", "Rain fell over the harbour", ["MATCH"]),
    "end": ("Rain fell over the harbar wals", "Rain fell over the harbour walls", ["MATCH", "DELETE", "INSERT"]),
    "middle": ("Rain fel ovr the harbour", "Rain fell over the harbour", ["MATCH", "DELETE", "INSERT", "MATCH"]),
    "start": ("Ra1n fell over the harbour", "Rain fell over the harbour", ["DELETE", "INSERT", "MATCH"]),
    "added": ("Rain over the harbour", "Rain fell over the harbour", ["MATCH", "INSERT", "MATCH"]),
    "missing": ("Rain fell over the harbour", "Rain over the harbour", ["MATCH", "DELETE", "MATCH"]),
}


def test_runs_and_markup(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in SENTENCES.items()], PAIRS)
    rows = R.reconcile_runs(df).orderBy("pair_id", "run_idx").collect()
    assert {k: [r.op for r in rows if r.pair_id == k] for k in SENTENCES} == {k: ops for k, (_, _, ops) in SENTENCES.items()}
    assert {tuple(r) for r in R.reconcile_runs(df, R.align_pairs(df)).collect()} == {tuple(r) for r in rows}
    markup = {r.pair_id: r.markup for r in R.reconcile(df).collect()}
    assert markup["middle"] == 'Rain <ocr var="0">fel ovr </ocr><ocr var="1">fell over </ocr>the harbour'
    assert markup["added"] == 'Rain <ocr var="1">fell </ocr>over the harbour'
    assert markup["equal"] == "Rain fell over the harbour"


@pytest.mark.parametrize("a,b,ops", [
    ("take 5mg/day with food", "take 5 mg / day with food", ["MATCH"]),         # the same word, spaced
    ("take 5mg/day with food", "take 5 mg / week with food", ["MATCH", "DELETE", "INSERT", "MATCH"]),
    ("x 12 y", "x 1 2 y", ["MATCH"]),
])
def test_respaced_words_agree(spark, a, b, ops):
    df = spark.createDataFrame([("p", a, b)], PAIRS)
    assert [r.op for r in R.reconcile_runs(df).orderBy("run_idx").collect()] == ops
    if ops == ["MATCH"]:
        assert R.reconcile(df).first().markup == a


def common_length(a, b):
    """Length of the longest common subsequence as the longest rise in the places of equal tokens."""
    places = {t: [j for j in reversed(range(len(b))) if b[j] == t] for t in set(a)}
    ends = []
    for token in a:
        for j in places[token]:
            k = bisect_left(ends, j)
            ends[k:k + 1] = [j]
    return len(ends)


@pytest.mark.parametrize("budget", [1 << 30, 16])
def test_alignment_properties(monkeypatch, budget):
    monkeypatch.setattr(R, "ROW_BUDGET", budget)
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(25))] for _ in range(2))
        steps = R._align(a, b)
        # Every token of both sides once and in order; matches are equal tokens and as many as can be.
        assert [i for op, i, _ in steps if op != "INSERT"] == list(range(len(a)))
        assert [j for op, _, j in steps if op != "DELETE"] == list(range(len(b)))
        matches = [(i, j) for op, i, j in steps if op == "MATCH"]
        assert all(a[i] == b[j] for i, j in matches) and len(matches) == common_length(a, b)
        # From the end: equal tokens match, and a deletion is taken only where an insertion would cost a match.
        left_a, left_b = len(a), len(b)
        for op, *_ in reversed(steps):
            here = a[:left_a], b[:left_b]
            if left_a and left_b and a[left_a - 1] == b[left_b - 1]:
                assert op == "MATCH"
            elif op == "DELETE":
                assert not left_b or common_length(here[0], here[1][:-1]) < common_length(*here)
            else:
                assert op == "INSERT" and (not left_a or common_length(here[0], here[1][:-1]) == common_length(*here))
            left_a, left_b = left_a - (op != "INSERT"), left_b - (op != "DELETE")


def test_few_differences_by_diagonals():
    rnd = random.Random(7)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(9))] for _ in range(2))
        assert R._single(R._align_runs(a, b)) == R._single(R._align_dense(a, b))
    # Of a long page with one word more on each side no step is made for each token.
    page = [f"w{i % 977}" for i in range(50_000)]
    steps = R._align_runs([*page[:1], "gone", *page[1:]], [*page[:-1], "new", *page[-1:]])
    assert [(op, n) for op, _, _, n in steps] == [("MATCH", 1), ("DELETE", 1), ("MATCH", 49_998), ("INSERT", 1), ("MATCH", 1)]
