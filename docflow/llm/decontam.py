"""Benchmark decontamination: BM25 over the test items, queried with every training passage.

Test items are split into question and answer (the last ``ANSWER`` of the words) and indexed as BM25
documents; scores are fractions of the score an item gives itself, so one threshold suits all.
Documents are cut into overlapping passages, each of which holds any item that starts in its first
half as a whole. Every passage is a query, evaluated as block-max WAND does: items are in blocks, each
posting list keeps its largest contribution per block, and a block is opened only for passages whose
summed block maxima reach the threshold. Opened blocks are scored exactly, and all items at or above
the threshold are verified. An item's threshold is lowered where a passage that would pass could score
less, so the search loses nothing that verification would find.

An item is found if at least ``overlap`` of its question and of its answer, or of the item as a whole,
stands in the passage. The share of a part is the larger of two: that of its five-word shingles, in any
place, and that of its words in order within a stretch that is longer than the part by at most as many
words as may be missing. So each part can lose, change or gain single words anywhere, and question and
answer may stand apart or in other order.

The index is broadcast in shards of at most ``SHARD_ITEMS`` items; a larger benchmark takes one pass
over the documents per shard. Document frequencies count all items.

Defined cases: a null or empty document is no query; a null or wordless item is never found; an item
with fewer words than a shingle is one shingle; ids may repeat or be null (their rows are returned
with that id); equal items are all reported; empty tables give an empty result; other columns are
not looked at. Words are runs of characters that are neither white space nor ASCII punctuation, and
A-Z count as a-z.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docflow.llm.bpe import gather
from docflow.llm.words import chunks

K1, B = 1.2, 0.75
BLOCK = 8                   # items of a block
SHARD_ITEMS = 20_000
PASSAGES = 4096             # passages searched at a time
SHINGLE = 5
ANSWER = 1 / 3
THRESHOLD = 0.6
OVERLAP = 0.8
CHUNK = 1_000_000
_PLAIN = bytes(32 if chr(i) in string.punctuation else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_PLAIN).split()


def shingled(words: list) -> set:
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def contained(part: list[bytes], found: set) -> float:
    own = shingled(part)
    return len(own & found) / len(own) if own else 1.0


def needed(n: int, overlap: float) -> int:
    """Words of ``n`` that must be found."""
    return math.ceil(n * overlap - 1e-9)


def aligned(part: list[bytes], words: list[bytes], overlap: float) -> float:
    """Largest share of ``part`` that stands in order in a stretch of ``words``; 0 if it is below ``overlap``."""
    n = len(part)
    need, masks = needed(n, overlap), {}
    for i, w in enumerate(part):
        masks[w] = masks.get(w, 0) | 1 << i
    hits = [masks.get(w, 0) for w in words]
    upto = [0, *accumulate(map(bool, hits))]
    most, full, long = 0, (1 << n) - 1, 2 * n - need
    for start, hit in enumerate(hits):
        end = min(start + long, len(hits))
        if not hit or upto[end] - upto[start] < max(need, most + 1):
            continue
        # Longest common subsequence; a zero bit is a word found.
        rest = full
        for h in hits[start:end]:
            if h:
                both = rest & h
                rest = (rest + both | rest - both) & full
        most = max(most, n - rest.bit_count())
    return most / n if n and most >= need else 0.0


def overlaps(item: list[bytes], words: list[bytes], found: set, overlap: float) -> tuple[float, float] | None:
    """Shares of question and answer that stand in a passage with the shingles ``found``, if the item is found in it."""
    cut = len(item) - max(1, round(len(item) * ANSWER))
    # Both parts with the words around the border, so that each has whole shingles.
    q, a = contained(item[:max(cut, SHINGLE)], found), contained(item[min(cut, len(item) - SHINGLE):], found)
    if q < overlap:
        q = max(q, aligned(item[:cut], words, overlap))
    if a < overlap:
        a = max(a, aligned(item[cut:], words, overlap))
    if q >= overlap and a >= overlap or contained(item, found) >= overlap or aligned(item, words, overlap) >= overlap:
        return q, a
    return None


class Index:
    """Inverted index of a shard of items, with block maxima."""

    def __init__(self, items: list[tuple[object, bytes]], df: dict[bytes, int], n_items: int, mean_words: float):
        # Items of similar length share a block, so that block maxima are close to what they bound.
        items = sorted(((i, w) for i, t in items if (w := words_of(t))), key=lambda x: (len(x[1]), x[1]))
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.longest = max(map(len, self.words), default=0)
        self.terms = {t: k for k, t in enumerate(sorted({t for w in self.words for t in w}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.parts: list[list[float]] = []      # scores of each item's words, the largest first
        for no, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / mean_words)
            part = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(words).items()}
            own = sum(part.values())
            self.parts.append(sorted((score / own for score in part.values()), reverse=True))
            for t, score in part.items():
                postings[self.terms[t]].append((no, score / own))
        lens = np.array([*map(len, postings)], np.int64)
        self.post_lens, self.post_starts = lens, np.cumsum(lens) - lens
        self.post_item = np.array([i for p in postings for i, _ in p], np.int64)
        self.post_score = np.array([s for p in postings for _, s in p], np.float64)
        # Block maxima of every posting list, which are in item order.
        blocks: list[dict[int, float]] = []
        for p in postings:
            most: dict[int, float] = {}
            for i, s in p:
                most[i // BLOCK] = max(most.get(i // BLOCK, 0.0), s)
            blocks.append(most)
        self.block_lens = np.array([*map(len, blocks)], np.int64)
        self.block_starts = np.cumsum(self.block_lens) - self.block_lens
        self.block_no = np.array([b for m in blocks for b in m], np.int64)
        self.block_max = np.array([s for m in blocks for s in m.values()], np.float64)
        self.n_blocks = (len(self.ids) + BLOCK - 1) // BLOCK

    def term_numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))

    def thresholds(self, threshold: float, overlap: float) -> np.ndarray:
        """``threshold`` for each item, or less where its best words can all be those that are missing."""
        lost = [len(w) - needed(len(w), overlap) if len(w) >= SHINGLE else 0 for w in self.words]
        return np.array([min(threshold, 1 - sum(p[:k])) for p, k in zip(self.parts, lost)], np.float64)

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the threshold (one, or one an item), from distinct (passage, term) rows sorted by passage."""
        if not len(passage):
            return passage, passage, passage.astype(np.float64)
        # Rounding must never close a block that holds an item at the threshold.
        least = np.broadcast_to(np.asarray(threshold, np.float64), len(self.ids)) - 1e-9
        n = self.block_lens[term]
        spot = gather(np.arange(len(self.block_no)), self.block_starts[term], n)
        key = np.repeat(passage, n) * self.n_blocks + self.block_no[spot]
        total = np.bincount(key, self.block_max[spot], minlength=(int(passage[-1]) + 1) * self.n_blocks)
        opened = total >= np.tile(np.minimum.reduceat(least, np.arange(0, len(least), BLOCK)), int(passage[-1]) + 1)
        rows = np.flatnonzero(opened.reshape(-1, self.n_blocks).any(axis=1)[passage])
        passage, term = passage[rows], term[rows]
        n = self.post_lens[term]
        spot = gather(np.arange(len(self.post_item)), self.post_starts[term], n)
        where, item = np.repeat(passage, n), self.post_item[spot]
        inside = opened[where * self.n_blocks + item // BLOCK]
        pairs, back = np.unique(where[inside] * len(self.ids) + item[inside], return_inverse=True)
        score = np.bincount(back, self.post_score[spot][inside], minlength=len(pairs))
        good = score >= least[pairs % len(self.ids)]
        return pairs[good] // len(self.ids), pairs[good] % len(self.ids), score[good]


def passages(counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) word ranges of all passages: 2 * half words, one every ``half`` words."""
    n = np.where(counts > 0, np.maximum(1, -(-(counts - half) // half)), 0)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[text]
    start = first + k * half
    return text, start, np.minimum(start + 2 * half, first + counts[text])


def _index_shards(items: DataFrame) -> Iterator[Index]:
    """One index per shard; what reaches the driver at a time is bounded by SHARD_ITEMS."""
    total = items.count()
    if not total:
        return
    shards = -(-total // SHARD_ITEMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            distinct = [sorted(set(w)) for w in words]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, distinct)]).astype(np.int32), pa.array(list(chain.from_iterable(distinct)), pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(map(len, words)), pa.int64()), lists], names=["shard", "n", "words"])

    sharded = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    counted = sharded.select("text", "shard").mapInArrow(run, "shard int, n long, words array<binary>")
    mean = max(1.0, counted.agg(F.avg("n")).first()[0])
    terms = counted.select("shard", F.explode("words").alias("word"))
    df = terms.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.collect_set("shard").alias("shards"))
    for shard in range(shards):
        own = sharded.where(F.col("shard") == shard).select("item_id", "text").collect()
        counts = df.where(F.array_contains("shards", shard)).select("word", "n").collect()
        yield Index([(r.item_id, (r.text or "").encode()) for r in own], {bytes(r.word): r.n for r in counts}, total, mean)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                 text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap) of each document and item found in it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("item_id", tests.schema["item_id"].dataType),
                         *[StructField(c, DoubleType()) for c in ("bm25", "question_overlap", "answer_overlap")]])
    found = spark.createDataFrame([], schema)
    for index in _index_shards(tests):
        if index.ids:
            found = found.unionByName(_search(rows, spark.sparkContext.broadcast(index), schema, threshold, overlap))
    return found


def _search(rows: DataFrame, shared, schema, threshold: float, overlap: float) -> DataFrame:
    ids = [schema.fields[i].dataType for i in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        index = shared.value
        least = index.thresholds(threshold, overlap)
        # What a stretch may hold at most (see ``aligned``) is the part of a passage where items start.
        half = 2 * index.longest - needed(index.longest, overlap)
        for part, texts in chunks(batches, 1, CHUNK):
            words = [words_of(t) for t in texts]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            terms = index.term_numbers(list(chain.from_iterable(words)))
            text, start, end = passages(counts, half)
            hits: list[tuple[int, int, float]] = []
            for g in range(0, len(text), PASSAGES):
                lens = (end - start)[g:g + PASSAGES]
                own = np.repeat(np.arange(len(lens)), lens)
                term = terms[gather(np.arange(len(terms)), start[g:g + PASSAGES], lens)]
                pairs = np.unique((own * len(index.terms) + term)[term >= 0])
                passage, item, score = index.search(pairs // len(index.terms), pairs % len(index.terms), least)
                hits.extend(zip((passage + g).tolist(), item.tolist(), score.tolist()))
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            first = np.cumsum(counts) - counts
            for p, i, s in hits:
                d = int(text[p])
                one = words[d][start[p] - first[d]:end[p] - first[d]]
                if len(index.words[i]) < SHINGLE:
                    found = {tuple(one[k:k + len(index.words[i])]) for k in range(len(one))}
                    shares = (1.0, 1.0) if contained(index.words[i], found) >= overlap else None
                else:
                    shares = overlaps(index.words[i], one, shingled(one), overlap)
                if shares:
                    best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (min(1.0, s), *shares))
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([d for d, _ in keys], pa.int64())),
                 pa.array([index.ids[i] for _, i in keys], to_arrow_type(ids[1])),
                 *[pa.array([best[k][j] for k in keys], pa.float64()) for j in range(3)]], names=schema.names)

    return rows.mapInArrow(run, schema)
