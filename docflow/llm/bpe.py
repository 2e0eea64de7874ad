"""BPE encoding by forced boundaries, and decoding.

A byte pair that occurs inside no vocabulary token can never end up inside a token, so the text may
be cut between such two bytes and each fragment encoded on its own: the concatenated ids are those of
the whole text. Two more conditions keep the splitting pattern, which runs before the merges, blind
to the cut: the left side must not end in white space (``\\s+(?!\\S)`` looks ahead) and the right side
must not start with an apostrophe (a contraction could match where a longer run did before).
Fragments repeat a lot, so each worker encodes a fragment once and gathers ids with numpy.

Defined cases: a null text encodes as the empty text, to no ids; a null id array decodes to the empty
text; ids outside the vocabulary are skipped, as the tokenizers library does; an empty table gives an
empty result; repeated rows repeat their result; other columns are not looked at.
"""

from __future__ import annotations

import ctypes
import json
import os
import sys
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAGMENTS = 200_000             # fragments looked up at a time
CACHE_IDS = 8_000_000
LONG = 256                      # longer fragments are not kept
BATCH_BYTES = 2_000_000         # text of one output batch, if its documents are not longer themselves

SPACES = tuple(c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ASCII_SPACES = b"\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f"


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start : start + len]`` one behind the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


class FragmentCache:
    """Ids of fragments, each encoded once by the tokenizers library."""

    KEPT = 200_000          # fragments kept by a worker before it starts afresh

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = 0
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        # Arrays with room to grow: ids of all fragments, and where each fragment's ids start.
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)

    def _forget(self) -> None:
        self._clear()
        self.known = 0

    def _encoded(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments one behind the other, and the number of ids of each, from the tokenizers library."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens

    def _store(self, fragments: list[bytes], flat: np.ndarray, lens: np.ndarray) -> None:
        n, ends = self.known, self.starts[self.known] + np.cumsum(lens)
        if not len(ends):
            return
        self.starts, self.flat = _room(self.starts, n + len(lens) + 1), _room(self.flat, int(ends[-1]))
        self.flat[self.starts[n]:ends[-1]] = flat
        self.starts[n + 1:n + len(lens) + 1] = ends
        self.codes.update(zip(fragments, range(n, n + len(lens))))
        self.known = n + len(lens)

    def _learn(self, new: list[bytes]) -> None:
        self._store(new, *self._encoded(new))

    def encode(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments one behind the other, and the number of ids of each."""
        if self.known > self.KEPT or self.starts[self.known] > CACHE_IDS:
            self._forget()
        codes = np.fromiter(map(self.codes.get, fragments, repeat(-1)), np.int64, len(fragments))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            new = list(dict.fromkeys([fragments[i] for i in unknown]))
            self._learn(new)
            codes[unknown] = [self.codes[fragments[i]] for i in unknown]
            for f in new:
                if len(f) > LONG:
                    del self.codes[f]
        starts = self.starts[codes]
        lens = self.starts[codes + 1] - starts
        return gather(self.flat, starts, lens), lens


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy of it with at least twice its length, so that it holds ``size`` values."""
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), array.dtype)
    grown[:len(array)] = array
    return grown


class BoundaryEncoder(FragmentCache):
    """Byte-level BPE over fragments between forced boundaries."""

    def __init__(self, path: str):
        super().__init__(path)
        inside = np.zeros((256, 256), bool)
        for token in token_bytes(path).values():
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        cut = ~inside
        cut[list(ASCII_SPACES)] = False
        cut[:, 0x27] = False
        cut[:, 0x80:0xC0] = False       # inside a character
        self.cut = cut.ravel()
        self.space_ends = np.zeros(256, bool)
        self.space_ends[[s[-1] for s in SPACES]] = True

    def bounds(self, data: bytes) -> np.ndarray:
        """Forced boundaries inside ``data``, ascending."""
        b = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(self.cut[b[:-1].astype(np.uint16) << 8 | b[1:]]) + 1
        odd = self.space_ends[b[at - 1]]
        if odd.any():
            spaced = np.fromiter((data[max(0, i - 3):i].endswith(SPACES) for i in at[odd].tolist()), bool, int(odd.sum()))
            odd[np.flatnonzero(odd)[~spaced]] = False
            at = at[~odd]
        return at

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and the number of ids of each text."""
        data = b"".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        # Texts are cut apart too: the pair across two texts says nothing.
        is_bound = np.zeros(len(data) + 1, bool)
        is_bound[0] = is_bound[ends] = is_bound[self.bounds(data)] = True
        bounds = np.flatnonzero(is_bound)
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(bounds) - 1, FRAGMENTS):
            part = bounds[k:k + FRAGMENTS + 1].tolist()
            some, lens = self.encode([data[s:e] for s, e in zip(part, part[1:])])
            ids.append(some)
            sizes.append(lens)
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        upto = before[np.searchsorted(bounds, ends)]
        return np.concatenate(ids), np.diff(upto, prepend=0)


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level vocabulary, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # The byte-level alphabet: printable Latin-1 stands for itself, the others follow from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}

    def raw(token: str) -> bytes:
        return bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    return {i: raw(t) for t, i in spec["model"]["vocab"].items()} | {a["id"]: raw(a["content"]) for a in spec["added_tokens"]}


def byte_slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most ``most`` bytes, or a single longer text."""
    lens = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
    start = size = 0
    for i, n in enumerate(lens):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lens):
        yield start, len(lens)


def raw_texts(texts: pa.Array) -> list[bytes]:
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]


_LOADED: dict = {}


def loaded(kind: type, path: str):
    """One encoder per worker, also across tasks."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of each row; ``path`` names a byte-level tokenizer file on every executor."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id", F.array().cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(BoundaryEncoder, path)
        for batch in batches:
            for s, e in byte_slices(batch.column(1)):
                part = batch.slice(s, e - s)
                ids, lens = encoder.encode_texts(raw_texts(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


class Decoder:
    def __init__(self, path: str):
        tokens = token_bytes(path)
        size = max(tokens) + 1
        pieces = [tokens.get(i, b"") for i in range(size)]
        self.lens = np.array([*map(len, pieces), 0], np.int64)      # the last one stands for unknown ids
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode_lists(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        known = np.where((ids >= 0) & (ids < len(self.lens) - 1), ids, len(self.lens) - 1)
        lens = self.lens[known]
        data = gather(self.flat, self.starts[known], lens).tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(counts)].tolist()
        return [data[s:e].decode("utf-8", "replace") for s, e in zip([0, *ends], ends)]


def decode(encoded: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, decoded) of each row."""
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    schema = rows.select("doc_id", "ids", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = loaded(Decoder, path)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                lists = part.column(1)
                counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoder.decode_lists(flat, counts), pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that earlier tasks of this worker have freed or kept for words; a worker lives through all stages of a job."""
    if words := sys.modules.get("docflow.llm.words"):
        words.HASHES.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # glibc only
        trim(0)


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, decoded) of each row: ``encode`` and ``decode`` in one Python worker instead of two."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id", F.array().cast("array<int>").alias("ids"), F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder, decoder = loaded(BoundaryEncoder, path), loaded(Decoder, path)
        for batch in batches:
            for s, e in byte_slices(batch.column(1)):
                part = batch.slice(s, e - s)
                ids, lens = encoder.encode_texts(raw_texts(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoder.decode_lists(ids, lens), pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, schema)
