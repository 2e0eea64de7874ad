"""Word hashes of texts, for operators that compare word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

from docflow.llm.bpe import byte_slices, raw_texts

KEPT = 250_000      # words a worker remembers
ODD = np.array([0x9E3779B97F4A7C15], np.uint64)      # an array, as numpy warns of wrapping scalars


class WordHashes(dict):
    """64-bit hash of each word, computed once for frequent words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT and len(word) < 100:
            self[word] = value
        return value


HASHES = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random (xor-shifts and odd factors)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text.

    Words are split at space and U+0009 to U+000D, which is what ``bytes.split`` does.
    """
    parts = [t.split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(parts)), np.uint64, int(counts.sum()))
    return flat, counts


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each ``n`` words in a row, by doubling; ``len(w) - n + 1`` values."""
    have, size, power = None, 0, ODD        # ``power`` is ODD to the length of ``step``
    step, length = w, 1
    while n:
        if n & 1:
            # have covers ``size`` words, step the next ``length`` words
            if have is None:
                have = step
            else:
                m = len(w) - size - length + 1
                have = have[:max(m, 0)] * power + step[size:size + max(m, 0)]
            size += length
        n >>= 1
        if n:
            m = max(len(step) - length, 0)
            step = step[:m] * power + step[length:length + m]
            power, length = power * power, length * 2
    return have


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text, and their texts."""
    for batch in batches:
        for s, e in byte_slices(batch.column(column), most):
            part = batch.slice(s, e - s)
            yield part, raw_texts(part.column(column))
