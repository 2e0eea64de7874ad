"""Two transcriptions of one page, aligned word by word.

Equal pairs never leave the JVM. For the others a longest-common-subsequence alignment
runs per pair inside Arrow batches, in time linear in the page where few words differ; runs, markup and rates are DataFrame work.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# White space of the aligner, and quotes treated as one.
SPACES = "\t\n\v\f\r " + "".join(map(chr, (
    0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
WORD = re.compile(f"[^{SPACES}]+")
QUOTES = re.compile("[`‘’]")
NATIVE_WORD = "[^\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
ALIGNMENT = ("pair_id string, pos int, op string, tok_a string, ia int, tok_b string, ib int, piece string")
RUNS = "pair_id string, run_idx int, op string, n long, text string"
ROW_BUDGET = 1024 * 1024 * 1024     # bits of table rows kept per pair (128 MB)
FEW = 64            # differing tokens up to which sides are compared along diagonals


def _words(text: str) -> tuple[list[str], list[int]]:
    """Normalised tokens and their offsets. The closing token starts one character into
    the last word, as in the behaviour this aligner has to match."""
    # Quotes are replaced one to one and are no white space, so words and offsets stay.
    words = [w.lower() for w in WORD.findall(QUOTES.sub("'", text))]
    offsets = [m.start() for m in WORD.finditer(text)]
    tail = offsets[-1] + 1 if offsets else 0
    words.append(QUOTES.sub("'", text[tail:]).lower())
    offsets.append(tail)
    return words, offsets


def _next_row(row: int, mask: int, full: int) -> int:
    """Bit-parallel step of the subsequence table: bit j is clear where the score grows
    from column j to j + 1."""
    hit = row & mask
    return ((row + hit) | (row - hit)) & full


def _align_dense(a: list, b: list) -> list[tuple[str, int, int, int]]:
    """``_align_runs`` by the whole subsequence table, for sides that differ in many tokens.

    A row of the table is one integer of len(b) bits. Only every k-th row is kept and the
    rows between are recomputed while walking back, so memory stays within
    ``ROW_BUDGET`` bits or grows with the square root of the text; no pair is refused.
    """
    masks: dict = {}
    for pos, token in enumerate(b):
        masks[token] = masks.get(token, 0) | (1 << pos)
    i, j, steps = len(a), len(b), []
    full = (1 << j) - 1
    every = max(1, math.isqrt(i)) if i * j > ROW_BUDGET else 1
    row, kept = full, [full]
    for r, token in enumerate(a, 1):
        row = _next_row(row, masks.get(token, 0), full)
        if r % every == 0:
            kept.append(row)
    low, rows = i + 1, []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            steps.append(("MATCH", i, j, 1))
            continue
        if i < low:
            low = (i // every) * every
            rows = [kept[low // every]]
            for r in range(low, min(low + every - 1, len(a))):
                rows.append(_next_row(rows[-1], masks.get(a[r], 0), full))
        # An unchanged score to the left means an insertion is as good as a deletion.
        if j and (i == 0 or (rows[i - low] >> (j - 1)) & 1):
            j -= 1
            steps.append(("INSERT", -1, j, 1))
        else:
            i -= 1
            steps.append(("DELETE", i, -1, 1))
    return steps[::-1]


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many first tokens of both are equal, compared in growing stretches."""
    most, at, width = min(len(a), len(b)), 0, 16
    while at < most:
        to = min(at + width, most)
        differs = a[at:to] != b[at:to]
        if differs.any():
            return at + int(differs.argmax())
        at, width = to, 4 * width
    return most


def _reaches(a: np.ndarray, b: np.ndarray, most: int) -> list[dict[int, int]] | None:
    """For d = 0, 1, … differences the furthest index in ``a`` reached on each diagonal (index in a less index in b), up
    to the d that reaches both ends; None if that is more than ``most``."""
    n, m = len(a), len(b)
    tables: list[dict[int, int]] = []
    for d in range(most + 1):
        before, table = tables[-1] if tables else {}, {}
        for k in range(-d, d + 1, 2):
            if k > n or -k > m:
                continue
            # One token of a more, or one of b more, than with a difference less.
            i = 0 if d == 0 else max(before.get(k - 1, -2) + 1, before.get(k + 1, -1))
            i = min(i, n, m + k)
            if i < max(k, 0):
                continue
            table[k] = i + _equal_ahead(a[i:], b[i - k:])
        tables.append(table)
        if table.get(n - m, -1) >= n:
            return tables
    return None


def _align_runs(a: list, b: list) -> list[tuple[str, int, int, int]]:
    """(op, index in a, index in b, n) of steps, a step of matches for ``n`` tokens in a row; −1 where a side has none;
    insertions win ties.

    Sides that differ in few tokens are compared along the diagonals those reach, others by the whole table. Both walk
    back the same way: what the table says of a cell on the way, or left of one, the diagonals say too, for its
    number of differences is at most that of the whole.
    """
    ids: dict = {}
    x = np.fromiter((ids.setdefault(t, len(ids)) for t in a), np.int64, len(a))
    y = np.fromiter((ids.setdefault(t, len(ids)) for t in b), np.int64, len(b))
    tables = _reaches(x, y, FEW)
    if tables is None:
        return _align_dense(x.tolist(), y.tolist())
    i, j, d, steps = len(a), len(b), len(tables) - 1, []
    while i or j:
        same = _equal_ahead(x[:i][::-1], y[:j][::-1])
        if same:
            i, j = i - same, j - same
            steps.append(("MATCH", i, j, same))
            continue
        d -= 1
        if j and (i == 0 or i <= tables[d].get(i - j + 1, -1)):
            j -= 1
            steps.append(("INSERT", -1, j, 1))
        else:
            i -= 1
            steps.append(("DELETE", i, -1, 1))
    return steps[::-1]


def _single(steps: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The same with a step for each token."""
    return [(op, i + k if i >= 0 else -1, j + k if j >= 0 else -1, 1) for op, i, j, n in steps for k in range(n)]


def _align(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """(op, index in a, index in b) of every token, −1 where a side has none; insertions win ties."""
    return [step[:3] for step in _single(_align_runs(a, b))]


def _without_respaced(steps: list[tuple[str, int, int, int]], a: list[str], b: list[str]) -> list[tuple[str, int, int, int]]:
    """A word that only its spacing tells from the other side is no difference: if the insertions right
    behind a deletion spell the deleted word, the deletion and its insertions go. An empty closing
    word is spelled by no insertion at all."""
    kept: list[tuple[str, int, int, int]] = []
    spelled = lambda run: "".join(b[step[2]] for step in run)
    for op, run in itertools.groupby(steps, key=lambda step: step[0]):
        run = list(run)
        behind_deletion = op == "INSERT" and kept and kept[-1][0] == "DELETE"
        if behind_deletion and spelled(run) == a[kept[-1][1]]:
            kept.pop()
        else:
            kept += run
    if kept and kept[-1][0] == "DELETE" and not a[kept[-1][1]]:
        kept.pop()
    return kept


def _pieces(text_a: str, text_b: str, steps: list[tuple[str, int, int, int]], off_a: list[int], off_b: list[int]) -> Iterator[str]:
    """The text that each step adds to the reading: that of side a, or of side b for an insertion."""
    at_a, at_b = 0, 0
    end = lambda off, k, text: off[k + 1] if k + 1 < len(off) else len(text)
    for op, ia, ib, n in steps:
        if op == "INSERT":
            to = end(off_b, ib + n - 1, text_b)
            piece, at_b = text_b[at_b:to], to
        else:
            to = end(off_a, ia + n - 1, text_a)
            piece, at_a = text_a[at_a:to], to
            if op == "MATCH":
                at_b = end(off_b, ib + n - 1, text_b)
        yield piece


def _pair_rows(pair_id: str, text_a: str, text_b: str) -> list[tuple]:
    a, off_a = _words(text_a)
    b, off_b = _words(text_b)
    steps = _single(_without_respaced(_align_runs(a, b), a, b))
    return [(pair_id, pos, op, a[ia] if ia >= 0 else None, ia if ia >= 0 else None, b[ib] if ib >= 0 else None, ib if ib >= 0 else None, piece)
            for pos, ((op, ia, ib, _), piece) in enumerate(zip(steps, _pieces(text_a, text_b, steps, off_a, off_b)))]


def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs that differ, spread over the cluster: alignment is quadratic in a page, so even
    a small table is worth a shuffle, and a large one gets the session's number of partitions."""
    differing = pairs.where(F.col("text_a") != F.col("text_b")).select(
        F.col("pair_id").cast("string").alias("pair_id"), "text_a", "text_b")
    spark = pairs.sparkSession
    return differing.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "pair_id")


def _map_pairs(pairs: DataFrame, rows_of, schema: str) -> DataFrame:
    def run(batches):
        import pandas as pd
        names = [c.split()[0] for c in schema.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).convert_dtypes()
        rows: list[tuple] = []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rows += rows_of(row.pair_id, row.text_a, row.text_b)
                if len(rows) > 50_000:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)
    return _spread(pairs).mapInPandas(run, schema)


def align_pairs(pairs: DataFrame) -> DataFrame:
    """Alignment table, one row per token, of ``pairs(pair_id, text_a, text_b)`` that differ."""
    return _map_pairs(pairs, _pair_rows, ALIGNMENT)


def _pair_runs(pair_id: str, text_a: str, text_b: str) -> list[tuple]:
    """Runs of one pair: far fewer rows to move than its tokens, and none is made for a token."""
    a, off_a = _words(text_a)
    b, off_b = _words(text_b)
    steps = _without_respaced(_align_runs(a, b), a, b)
    read = zip(steps, _pieces(text_a, text_b, steps, off_a, off_b))
    grouped = ((op, list(run)) for op, run in itertools.groupby(read, key=lambda r: r[0][0]))
    return [(pair_id, k, op, sum(step[3] for step, _ in run), "".join(piece for _, piece in run)) for k, (op, run) in enumerate(grouped)]


def runs_of(alignment: DataFrame) -> DataFrame:
    """Runs from an alignment table: a run starts where the operation changes."""
    w = Window.partitionBy("pair_id").orderBy("pos")
    changed = F.coalesce((F.col("op") != F.lag("op").over(w)).cast("int"), F.lit(0))
    rows = alignment.withColumn("_c", changed).withColumn(
        "run_idx", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.groupBy("pair_id", "run_idx").agg(
        F.first("op").alias("op"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
        .alias("text"))


def reconcile_runs(pairs: DataFrame, alignment: DataFrame | None = None) -> DataFrame:
    """(pair_id, run_idx, op, n, text): runs of equal operations along each pair; of a given
    alignment table, or aligned here."""
    if alignment is None:
        runs = _map_pairs(pairs, _pair_runs, RUNS)
    else:
        runs = runs_of(alignment)
    equal = pairs.where(F.col("text_a") == F.col("text_b")).select(
        F.col("pair_id").cast("string").alias("pair_id"), F.lit(0).alias("run_idx"), F.lit("MATCH").alias("op"),
        (F.regexp_count("text_a", F.lit(NATIVE_WORD)) + 1).cast("long").alias("n"), F.col("text_a").alias("text"))
    return runs.unionByName(equal)


def render_markup(runs: DataFrame) -> DataFrame:
    """(pair_id, markup): runs in order, differing ones tagged by transcription."""
    tagged = (F.when(F.col("op") == "DELETE", F.concat(F.lit('<ocr var="0">'), "text", F.lit("</ocr>")))
              .when(F.col("op") == "INSERT", F.concat(F.lit('<ocr var="1">'), "text", F.lit("</ocr>")))
              .otherwise(F.col("text")))
    return runs.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("run_idx", tagged.alias("t")))), lambda x: x["t"]), "").alias("markup"))


def disagreement_stats(runs: DataFrame) -> DataFrame:
    """Per pair: matched, deleted and inserted tokens, and the share that differs."""
    n = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("n"))), F.lit(0)).cast("long")
    return runs.groupBy("pair_id").agg(n("MATCH").alias("matched"), n("DELETE").alias("deleted"),
                                       n("INSERT").alias("inserted")).withColumn(
        "disagreement", F.round((F.col("deleted") + F.col("inserted"))
                                / F.greatest(F.col("matched") + F.col("deleted") + F.col("inserted"), F.lit(1)), 6))


def reconcile(pairs: DataFrame) -> DataFrame:
    """(pair_id, markup) of every pair; equal pairs come back unchanged."""
    return render_markup(reconcile_runs(pairs))
