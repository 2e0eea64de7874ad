"""Token ids in binary shards: each document compressed on its own with one shared dictionary.

Format. ``shards/part-*.ztok``: zstandard frames one behind the other, one for each document in
ascending id order; a frame holds the ids as little-endian unsigned 32-bit integers. ``dictionary/``:
one row with the dictionary and its SHA-256, trained on serialised id arrays. ``index/``: Parquet rows
(doc_id, shard_no, file, offset, length, n_tokens, start, dictionary hash), so that one short document
is read by one small range request. Shard numbers follow the id order; ``start`` counts the ids of all
documents before.

The dictionary is fitted on at most ``fit_docs`` documents (those with the smallest hash of their id)
and on a range of at most ``fit_bytes`` of the ids of each, which begins at a place given by a hash of all of
them; everything else covers all documents.

Defined cases: a null text encodes as the empty text, so its only id is the end id; null ids come
first in the order and equal ids are ordered by text; an empty table gives an empty result; with too
few ids to train a dictionary, frames are compressed without one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.bpe import CACHE_IDS, LONG, FragmentCache, byte_slices, gather, loaded, raw_texts, token_bytes
from docflow.llm.scratch import scratch_dir, staged
from docflow.llm.shards import ShardReader, ShardWriter

LEVEL = 3
DICTIONARY_BYTES = 64 * 1024
WORDS_AT_ONCE = 200_000


END = "\x01"        # stands for the end of a word; no plain word holds it


def quick_words(path: str):
    """An encoder with the same ids for words of a-z followed by ``END``, several times as fast; None if the ids are not in
    the order of merges, before which each last letter becomes one with the end of its word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, parts = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = vocabulary["".join(parts[0])] if parts else 0
    letters = [vocabulary.get(chr(97 + i) + "</w>", first) for i in range(26)]
    if model.get("end_of_word_suffix") != "</w>" or max(letters) >= first or any(vocabulary["".join(m)] != first + i for i, m in enumerate(parts)):
        return None
    import tiktoken
    ranks = {t: i for i, t in token_bytes(path).items() if i < first + len(parts) and not vocabulary_end(t)}
    ranks |= {t[:-4] + END.encode(): i for i, t in token_bytes(path).items() if i < first + len(parts) and vocabulary_end(t)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=f"[a-z]+{END}", mergeable_ranks=ranks, special_tokens={})


def vocabulary_end(token: bytes) -> bool:
    return token.endswith(b"</w>")


class WordEncoder(FragmentCache):
    """Ids of texts whose tokenizer drops white space and lowers case: words never share a token, so each is encoded once.

    Texts are cut at ASCII white space; A-Z become a-z first, as the tokenizer does. Of a new word that
    ends in punctuation behind a letter, where the tokenizer's pattern always cuts, the two parts are
    looked up. Only texts that may hold a special token are taken as they are.
    """

    TAIL = b".,;:!?"
    JOINED = 4000       # words of letters encoded in one call
    KEPT = 1_000_000

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit
        # For a-z alone the tokenizer's normalisers and pattern change nothing, so its merges are enough.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.quick = quick_words(path)

    @classmethod
    def core(cls, word: bytes) -> bytes:
        """The word without punctuation at its end, or the word itself if no letter stands before that."""
        core = word.rstrip(cls.TAIL)
        if core and (97 <= core[-1] <= 122 or len(core) > 1 and core[-2] == 0xC3 and core[-1] not in (0x97, 0xB7)):
            return core
        return word

    def _forget(self) -> None:
        """Keep what was learned first: frequent words are met early, so most words met again are among them."""
        keep = min(self.KEPT, int(np.searchsorted(self.starts[:self.known + 1], CACHE_IDS)))
        while self.codes:
            word, code = self.codes.popitem()
            if code < keep:
                self.codes[word] = code
                break
        self.known = keep

    def _learn(self, new: list[bytes]) -> None:
        cores = list(map(self.core, new))
        tails = [f[len(c):] for f, c in zip(new, cores)]
        parts = [p for p in dict.fromkeys(chain(cores, filter(None, tails))) if p not in self.codes]
        self._store(parts, *self._encoded(parts))
        cut = [i for i, t in enumerate(tails) if t]
        codes = np.fromiter(chain.from_iterable((self.codes[cores[i]], self.codes[tails[i]]) for i in cut), np.int64, 2 * len(cut))
        starts = self.starts[codes]
        lens = self.starts[codes + 1] - starts
        self._store([new[i] for i in cut], gather(self.flat, starts, lens), lens.reshape(-1, 2).sum(axis=1))
        for p in {p for p in parts if len(p) > LONG}.difference(new):
            del self.codes[p]

    def _encoded(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only share calls: each is one piece for the merges, so its last id ends a word."""
        texts = [f.decode() for f in fragments]
        kinds = [2 if f.islower() and f.isalpha() else int(t.isalpha()) for f, t in zip(fragments, texts)]
        rest, some_letters, plain = ([i for i, k in enumerate(kinds) if k == want] for want in range(3))
        order, flat, lens = [], [], []
        if self.quick and plain:
            ids = np.array(self.quick.encode_ordinary("".join([texts[i] + END for i in plain])), np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain):
                order, flat, lens, plain = plain, [ids], [np.diff(ends, prepend=0)], []
        for tokenizer, words in ((self.merges, plain), (self.tokenizer, some_letters)):
            groups = [words[k:k + self.JOINED] for k in range(0, len(words), self.JOINED)]
            for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, np.int32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(group):
                    order += group
                    flat.append(ids)
                    lens.append(np.diff(ends, prepend=0))
                else:
                    rest += group
        some, n = super()._encoded([fragments[i] for i in rest])
        have, sizes = np.concatenate([*flat, some]), np.concatenate([*lens, n])
        place = np.argsort(np.array(order + rest, np.int64))
        return gather(have, (np.cumsum(sizes) - sizes)[place], sizes[place]), sizes[place]

    def serialised(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Each text's ids and the end id as little-endian unsigned 32-bit integers."""
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        flat = list(chain.from_iterable(words))
        parts = [self.encode(flat[k:k + WORDS_AT_ONCE]) for k in range(0, len(flat), WORDS_AT_ONCE)]
        if not parts:
            return [np.array([end_id], "<u4").tobytes()] * len(texts)
        data = np.concatenate([ids for ids, _ in parts]).astype("<u4").tobytes()
        before = 4 * np.concatenate([[0], np.cumsum(np.concatenate([lens for _, lens in parts]))])
        ends = before[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))].tolist()
        end = np.array([end_id], "<u4").tobytes()
        return [data[s:e] + end for s, e in zip([0, *ends], ends)]


def _range_of(ids: bytes, size: int) -> bytes:
    """At most ``size`` bytes of whole ids, from a place given by a hash of all of them."""
    places = max(0, len(ids) - size) // 4 + 1
    start = 4 * (xxhash.xxh3_64_intdigest(ids) % places)
    return ids[start:start + size]


def train_dictionary(docs: DataFrame, path: str, end_id: int, fit_docs: int = 2000, fit_bytes: int = 4096) -> bytes:
    """The shared dictionary (empty if there is too little to learn from), from a bounded sample."""
    some = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(fit_docs).select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(WordEncoder, path)
        for batch in batches:
            for s, e in byte_slices(batch.column(0)):
                ids = [_range_of(i, fit_bytes) for i in encoder.serialised(raw_texts(batch.column(0).slice(s, e - s)), end_id)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    encoded = docs.join(some, "doc_id").select("text").mapInArrow(run, "ids binary").limit(fit_docs)
    samples = [bytes(r.ids) for r in encoded.collect()]
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES or len(samples) < 16:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(samples)).as_bytes()


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id",
                 fit_docs: int = 2000) -> DataFrame:
    """Write shards, dictionary and index below ``folder``; returns the index."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    dictionary = train_dictionary(rows, path, end_id, fit_docs)
    digest = hashlib.sha256(dictionary).hexdigest()
    staged(spark.createDataFrame([(digest, bytearray(dictionary))], "dictionary_hash string, dictionary binary"), folder, "dictionary")
    shards = f"{folder}/shards"
    schema = rows.select("doc_id", *[F.lit(0).cast(kind).alias(name) for name, kind in (
        ("shard_no", "int"), ("file", "string"), ("offset", "long"), ("length", "long"), ("n_tokens", "long"), ("before", "long"))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(WordEncoder, path)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        no = TaskContext.get().partitionId()
        shard, before = ShardWriter(shards, no, "ztok"), 0
        for batch in batches:
            for s, e in byte_slices(batch.column(1)):
                part, offsets, lengths, counts, upto = batch.slice(s, e - s), [], [], [], []
                for ids in encoder.serialised(raw_texts(part.column(1)), end_id):
                    frame = packer.compress(ids)
                    offsets.append(shard.append(frame))
                    lengths.append(len(frame))
                    counts.append(len(ids) // 4)
                    upto.append(before)
                    before += len(ids) // 4
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([no] * n, pa.int32()), pa.array([shard.name] * n, pa.string()),
                     *[pa.array(v, pa.int64()) for v in (offsets, lengths, counts, upto)]], names=schema.names)
        shard.close()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = staged(ordered.mapInArrow(run, schema), folder, "written")
    # One row per shard, so a window over all of them stays small however many documents there are.
    totals = written.groupBy("shard_no").agg(F.sum("n_tokens").alias("ids"))
    base = totals.select("shard_no", F.coalesce(F.sum("ids").over(
        Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"))
    index = written.join(base, "shard_no").select(
        "doc_id", "shard_no", "file", "offset", "length", "n_tokens", (F.col("base") + F.col("before")).alias("start"),
        F.lit(digest).alias("dictionary_hash"))
    return staged(index, folder, "index")


def read_tokens(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """Index rows (all, or those given) with ``ids``, the frame's content as little-endian bytes.

    Rows of a shard are read in offset order, neighbouring frames in one request.
    """
    index = spark.read.parquet(f"{folder}/index") if index is None else index
    # One row; its size is bounded by DICTIONARY_BYTES.
    digest, dictionary = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, shards = bytes(dictionary), f"{folder}/shards"
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary of {folder} does not have its hash")
    rows = index.select("doc_id", "start", "n_tokens", "file", "offset", "length", "dictionary_hash")
    schema = rows.select("doc_id", "start", "n_tokens", F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        reader = ShardReader(shards)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                files, offsets, lengths, hashes = (part.column(i).to_pylist() for i in (3, 4, 5, 6))
                if set(hashes) - {digest}:
                    raise ValueError(f"frames of {folder} need another dictionary")
                ids: list[bytes] = [b""] * part.num_rows
                for name in dict.fromkeys(files):
                    own = sorted((i for i, f in enumerate(files) if f == name), key=offsets.__getitem__)
                    for k, frame in reader.ranges(name, [(offsets[i], lengths[i]) for i in own]):
                        ids[own[k]] = unpacker.decompress(frame)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.binary())], names=schema.names)

    return rows.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def token_roundtrip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write all documents, then read them back: (doc_id, start, n_tokens, ids)."""
    folder = scratch_dir(docs.sparkSession)
    write_tokens(docs, folder, path, end_id)
    return read_tokens(docs.sparkSession, folder)


