"""Language identification with bit-sliced Bloom filters.

One table of bit positions serves all languages: position i holds a mask with a bit for each language
whose filter has bit i set, so one look-up per hash returns all languages at once, and the AND of the
``HASHES`` masks of an n-gram is the set of languages that contain it. A text's hits per language are
the popcounts of these masks over all its n-grams. Hits that a filter gives by chance are known from
its fill, and taken off: (hits - n·f) / (1 - f). The language with the largest corrected share wins.

The filters hold the most frequent n-grams of at most ``fit_docs`` texts per language (those with the
smallest hash of their id) from the rows the caller allows, at most ``grams_per_lang`` each, however
rare they are; every text is scored as a whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text none of whose
n-grams is known, like a table without labels, gets the language with most texts (``und`` if there is
none) and score 0; equal shares go to the language with more texts, then by name; ids may be null or
repeat; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.bpe import byte_slices
from docflow.llm.words import mix

ORDERS = (3, 4, 5)          # bytes of an n-gram
TABLE_BITS = 20
HASHES = 3
CHUNK = 500_000
UNKNOWN = "und"


def gram_hashes(data: np.ndarray, order: int) -> np.ndarray:
    """A hash of each ``order`` bytes in a row."""
    n = max(len(data) - order + 1, 0)
    packed = np.full(n, order, np.uint64)
    for k in range(order):
        packed = packed << np.uint64(8) | data[k:k + n]
    return mix(packed)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 of all texts, each between two spaces, and the end of each."""
    parts = [b" " + t.lower().encode() + b" " for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))


@dataclass
class Filters:
    langs: list[str]            # by falling number of texts
    table: np.ndarray           # (positions, bytes of the mask)
    chance: np.ndarray          # false positive rate of each language

    @staticmethod
    def positions(hashes: np.ndarray) -> list[np.ndarray]:
        return [(hashes >> np.uint64(k * TABLE_BITS)).astype(np.int64) & ((1 << TABLE_BITS) - 1) for k in range(HASHES)]

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], langs: list[str]) -> Filters:
        table = np.zeros((1 << TABLE_BITS, max(1, -(-len(langs) // 8))), np.uint8)
        for i, lang in enumerate(langs):
            for at in cls.positions(grams.get(lang, np.zeros(0, np.uint64))):
                table[at, i // 8] |= np.uint8(1 << i % 8)
        fill = np.unpackbits(table, axis=1, bitorder="little").mean(axis=0)[:len(langs)]
        return cls(langs, table, fill ** HASHES)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Corrected share of known n-grams, by text and language."""
        data, ends = joined(texts)
        hits, total = np.zeros((len(texts), 8 * self.table.shape[1])), np.zeros(len(texts))
        bit = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        for order in ORDERS:
            at = self.positions(gram_hashes(data, order))
            text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[:len(at[0])]
            inside = np.arange(len(text)) + order <= ends[text]
            total += np.bincount(text[inside], minlength=len(texts))
            for s in range(self.table.shape[1]):
                mask = self.table[at[0], s]
                for more in at[1:]:
                    mask = mask & self.table[more, s]
                seen = np.bincount((text * 256 + mask)[inside], minlength=256 * len(texts)).reshape(len(texts), 256)
                hits[:, 8 * s:8 * s + 8] += seen @ bit
        n = np.maximum(total, 1)[:, None]
        return np.clip((hits[:, :len(self.langs)] - n * self.chance) / (1 - np.minimum(self.chance, 0.999)) / n, 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        shares = self.shares([t or "" for t in texts])
        best, total = shares.argmax(axis=1), shares.sum(axis=1)
        score = np.where(total > 0, shares.max(axis=1) / np.where(total > 0, total, 1), 0.0)
        lettered = [t is not None and next(filter(str.isalpha, t), None) is not None for t in texts]
        return ([self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)],
                [s if ok else 0.0 for s, ok in zip(score.tolist(), lettered)])


def fit(docs: DataFrame, learn: Column, fit_docs: int = 1000, grams_per_lang: int = 40_000, text: str = "text", lang: str = "lang",
        doc_id: str = "doc_id") -> Filters:
    """Filters from rows where ``learn`` holds and the language is not null."""
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = rows.select("lang", "doc_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= fit_docs).drop("r").distinct()
    # At most fit_docs rows per language.
    sample = rows.join(F.broadcast(some), ["lang", "doc_id"], "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in byte_slices(batch.column(1), CHUNK):
                part = batch.slice(s, e - s)
                names, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                for name in dict.fromkeys(names):
                    data, ends = joined([t for n, t in zip(names, texts) if n == name])
                    for order in ORDERS:
                        hashes, n = np.unique(gram_hashes(data, order), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(hashes.view(np.int64)), pa.array(n)],
                                                         names=["lang", "gram", "n"])

    grams = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for name in langs:
        top = grams.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(grams_per_lang).select("gram").toArrow()
        found[name] = top.column("gram").to_numpy().view(np.uint64)
    return Filters.build(found, langs)


def identify(docs: DataFrame, filters: Filters, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(filters)
    schema = rows.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in byte_slices(batch.column(1), CHUNK):
                part = batch.slice(s, e - s)
                langs, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
