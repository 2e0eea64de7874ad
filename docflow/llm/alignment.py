"""Alignment of the tokens of two tokenizers, and how often each pair of ids is linked in a corpus.

Both tokenizers read a space and the text: A (byte-level) is given the space, B (pieces) adds it. Where a
token of A and a token of B end at the same byte, the tokens before form a group and the two tokens
are linked. No token of either vocabulary is empty, so such a byte ends one token of each.

A space after a character that is not white space starts a new token in both: A's pattern cuts
there, and no piece of B holds a space behind another character. Texts are therefore cut at these spaces
and every fragment is aligned once a worker, however often it occurs.

1. First pass: each task counts its fragments and from them its id pairs (partial counts, as a table).
2. The distinct pairs are dealt by hash to shards of about ``SHARD`` keys. Each shard gets a minimal perfect hash:
   levels of bits, a key being placed in the first level where nothing else falls on its bit; the
   rank of that bit is its index. The key itself is kept at its index, so foreign pairs are told apart.
3. Partial counts become dense vectors by index, one for each shard and leaf, which are summed up a tree.
4. Second pass: documents are aligned again and the counts of their links looked up in the vectors.

Defined cases: null and empty texts, and texts whose tokens do not give back their bytes (U+2581 reads
as a space in B), have no tokens, no groups and zero counts; they add nothing to the counts. Null and
repeated ids are carried through; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.bpe import _room, byte_slices, gather, loaded, token_bytes
from docflow.llm.scratch import scratch_dir, staged
from docflow.llm.shards import opened
from docflow.llm.words import mix

# Fixed value: how byte-level tokenizers cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that every version of Unicode takes for the same; a fragment ends in no white space.
PLAIN = re.compile("[\n\t -~\u00a1-\u024f]*[!-~\u00a1-\u024f]")
BATCH = 6_000_000       # bytes of text aligned together
KEPT = 300_000          # fragments a worker remembers; the frequent ones come first
LONG = 64               # longer fragments are not remembered
FLUSH = 2_000_000       # pairs a task holds before it sums them up
SHARD = 1 << 18         # keys of a shard
GAMMA = 2.0             # bits of a level for each key left
FAN = 4                 # vectors added in one step of the tree
CACHE_BYTES = 192 << 20     # tables of shards a worker keeps
INDEX = "shard int, bits binary, sizes array<long>, keys binary"


class Aligner:
    """Tokens, groups and links of fragments."""

    def __init__(self, paths: tuple[str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(paths[0])
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=paths[1])
        self.space = self.b.piece_to_id("▁")
        tokens = token_bytes(paths[0])
        self.quick = _quick(paths[0], tokens)
        self.a_flat, self.a_start, self.a_len = _vocabulary([tokens.get(i, b"") for i in range(max(tokens) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space behind another character")
        self.names = [np.array(_printed(max(tokens) + 1, "|"), object), np.array(_printed(len(pieces), ";"), object)]
        self.b_flat, self.b_start, self.b_len = _vocabulary(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
             else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def align(self, fragments: list[str]) -> dict[str, np.ndarray]:
        """Of fragments without their first space: ids of A and B one behind the other, the number of each
        by fragment, positions of the linked tokens, links by fragment, and which give back their bytes."""
        data = [(" " + f).encode() for f in fragments]
        size = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(size)
        text = np.frombuffer(b"".join(data), np.uint8)
        a = self._ids_of_a(fragments)
        lists = self.b.encode(fragments, num_threads=1)
        for i, f in enumerate(fragments):
            if not f:                       # the library adds no space to an empty text
                lists[i] = [self.space]
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))

        end_a = np.cumsum(self.a_len[a])
        n_a = np.diff(np.searchsorted(end_a, ends, side="right"), prepend=0)
        good = np.ones(len(data), bool)
        if not _same(gather(self.a_flat, self.a_start[a], self.a_len[a]), text):
            good &= self._intact(a, n_a, data, self.a_flat, self.a_start, self.a_len)
        last = np.cumsum(n_b)
        upto = np.concatenate([[0], np.cumsum(self.b_len[b])])
        own = upto[last] - upto[last - n_b]         # bytes of B's tokens of each fragment
        if not (_same(own, size) and _same(gather(self.b_flat, self.b_start[b], self.b_len[b]), text)):
            good &= self._intact(b, n_b, data, self.b_flat, self.b_start, self.b_len)
        end_b = upto[1:] + np.repeat(ends - size - upto[last - n_b], n_b)
        of_a, of_b = np.repeat(good, n_a), np.repeat(good, n_b)
        at_a = np.flatnonzero(np.isin(end_a, end_b[of_b]) & of_a)
        at_b = np.flatnonzero(np.isin(end_b, end_a[of_a]) & of_b)
        links = np.bincount(np.repeat(np.arange(len(data)), n_a)[at_a], minlength=len(data))
        return {"a": a, "b": b, "n_a": n_a, "n_b": n_b, "at_a": at_a, "at_b": at_b, "links": links, "good": good}

    def _ids_of_a(self, fragments: list[str]) -> np.ndarray:
        """Ids of all fragments one behind the other."""
        plain = [bool(PLAIN.fullmatch(f)) for f in fragments]
        if self.quick is None or not all(plain):
            lists = [None] * len(fragments)
            odd = [i for i, p in enumerate(plain) if not p or self.quick is None]
            for i, e in zip(odd, self.a.encode_batch_fast([" " + fragments[i] for i in odd], add_special_tokens=False)):
                lists[i] = e.ids
            for i in [i for i, ids in enumerate(lists) if ids is None]:
                lists[i] = self.quick.encode_ordinary(" " + fragments[i])
            return np.fromiter(chain.from_iterable(lists), np.int64)
        # One call for all of them: each ends in a character after which a space starts a new token.
        return np.array(self.quick.encode_ordinary("".join(map(" ".__add__, fragments))), np.int64)

    @staticmethod
    def _intact(ids: np.ndarray, counts: np.ndarray, data: list[bytes], flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        stops = np.cumsum(counts).tolist()
        return np.array([gather(flat, start[ids[s:e]], size[ids[s:e]]).tobytes() == d for s, e, d in zip([0, *stops], stops, data)], bool)

    def groups(self, found: dict[str, np.ndarray]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each fragment."""
        of_a, of_b = (np.repeat(np.arange(len(found["good"])), found[n]) for n in ("n_a", "n_b"))
        names, place, used = [], [], []
        for k, (side, own) in enumerate((("a", of_a), ("b", of_b))):
            ends = np.zeros(len(own), np.int64)
            ends[found[f"at_{side}"]] = 1
            names.append(self.names[k][found[side] * 2 + ends])
            place.append((np.cumsum(ends) - ends) * 2 + k)      # by group, A's tokens before B's
            used.append(found["good"][own])
        used, place = np.concatenate(used), np.concatenate(place)
        order = np.flatnonzero(used)[np.argsort(place[used], kind="stable")]
        parts = np.concatenate(names)[order].tolist()
        stops = np.cumsum((found["n_a"] + found["n_b"]) * found["good"]).tolist()
        return ["".join(parts[s:e])[:-1] for s, e in zip([0, *stops], stops)]


def _printed(count: int, last: str) -> list[str]:
    """Each id before another of its side and, next to it, at the end of its side of a group."""
    return [f"{i}{end}" for i in range(count) for end in (",", last)]


def _vocabulary(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens one behind the other, where each starts, and their lengths."""
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lens) - lens, lens


def _quick(path: str, tokens: dict[int, bytes]):
    """An encoder with the same ids for ``PLAIN`` fragments, several times as fast; None if ids are not in the order of merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(parts)):
        return None
    import tiktoken
    added = {t["id"] for t in spec["added_tokens"]}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks={t: i for i, t in tokens.items() if i not in added}, special_tokens={})


def _same(x: np.ndarray, y: np.ndarray) -> bool:
    return len(x) == len(y) and bool((x == y).all())


JOINED = re.compile(r"(?:\A|\s) ")      # a space that starts no fragment


def fragments_of(text: str) -> list[str]:
    """The fragments of a space and ``text``, each without its first space."""
    parts = text.split(" ")
    if not JOINED.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


class Fragments:
    """What is known of fragments: codes and, by code, numbers that ``learn`` gives."""

    def __init__(self, learn):
        self.learn, self.codes, self.known = learn, {}, 0
        self.columns: dict[str, np.ndarray] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the fragments of all texts, and the number of fragments of each text."""
        parts = [fragments_of(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(chain.from_iterable(parts))
        codes = np.fromiter(map(self.codes.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            new = dict.fromkeys(flat[i] for i in unknown)
            for code, f in enumerate(new, self.known):
                new[f] = code
            names = list(new)
            for name, values in self.learn(names).items():
                column = _room(self.columns.setdefault(name, np.zeros(1 << 12, values.dtype)), self.known + len(names))
                column[self.known:self.known + len(names)] = values
                self.columns[name] = column
            codes[unknown] = [new[flat[i]] for i in unknown]
            self.fresh = names
        else:
            self.fresh = []
        return codes, counts

    def keep(self) -> None:
        """Remember the fragments just learned while there is room; the others are forgotten."""
        for f in self.fresh[:max(0, KEPT - self.known)]:
            if len(f) <= LONG:
                self.codes[f] = self.known
            self.known += 1
        self.fresh = []


def by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each fragment) of each text."""
    upto = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(counts)
    return upto[stops] - upto[stops - counts]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for s, e in byte_slices(batch.column(column), BATCH):
            part = batch.slice(s, e - s)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
    return pairs, np.bincount(place, np.concatenate(counts), len(pairs)).astype(np.int64)


class Counter:
    """Pair counts of one task at a time; fragments are remembered across tasks."""

    def __init__(self, *paths: str):
        self.aligner = loaded(Aligner, paths)
        self.fragments = Fragments(self._learn)
        self.links: list[np.ndarray] = []       # pairs linked in the remembered fragments
        self.start()

    def start(self) -> None:
        """Begin a task; what a task that failed has counted is forgotten."""
        self.seen = np.zeros(1, np.int64)       # occurrences of the remembered fragments
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def _learn(self, new: list[str]) -> dict[str, np.ndarray]:
        found = self.aligner.align(new)
        self.new_links = found["a"][found["at_a"]] << 32 | found["b"][found["at_b"]]
        return {"links": found["links"], "good": found["good"]}

    def add(self, texts: list[str]) -> None:
        self.new_links = np.zeros(0, np.int64)
        codes, counts = self.fragments.encode(texts)
        columns, known = self.fragments.columns, self.fragments.known
        total = known + len(self.fragments.fresh)
        good = by_text(~columns["good"][codes], counts) == 0
        good &= np.fromiter(map(bool, texts), bool, len(texts))
        seen = np.bincount(codes[np.repeat(good, counts)], minlength=total)
        self.seen = _room(self.seen, max(known, 1))
        self.seen[:known] += seen[:known]
        self.keys.append(self.new_links)
        self.counts.append(np.repeat(seen[known:], columns["links"][known:total]))
        self.fragments.keep()
        # Later occurrences of what is remembered now count by ``seen``.
        self.links.append(self.new_links[:int(columns["links"][known:self.fragments.known].sum())])

    def drained(self) -> tuple[np.ndarray, np.ndarray]:
        known = self.fragments.known
        seen = _room(self.seen, max(known, 1))[:known]
        links = np.concatenate([np.zeros(0, np.int64), *self.links])
        self.links = [links]
        if known:
            self.keys.append(links)
            self.counts.append(np.repeat(seen, self.fragments.columns["links"][:known]))
        self.seen = np.zeros(max(known, 1), np.int64)
        pairs, n = _summed([np.zeros(0, np.int64), *self.keys], [np.zeros(0, np.int64), *self.counts])
        self.keys, self.counts = [], []
        return pairs[n > 0], n[n > 0]

    def held(self) -> int:
        return sum(map(len, self.keys))


def partial_counts(docs: DataFrame, paths: tuple[str, str], text: str = "text") -> DataFrame:
    """(pair, n): counts of linked ids (A's in the upper half of ``pair``), some rows for each pair and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = only(Counter, *paths)
        counter.start()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, counter.drained())), names=["pair", "n"])

        for _, texts in _texts(batches, 0):
            counter.add(texts)
            if counter.held() > FLUSH:
                counter.keys, counter.counts = ([x] for x in _summed(counter.keys, counter.counts))
                if counter.held() > FLUSH // 2:
                    yield rows()
        yield rows()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "pair long, n long")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, with the keys at their indexes."""

    def __init__(self, bits: np.ndarray, sizes: list[int], keys: np.ndarray):
        self.bits, self.sizes, self.keys = bits, sizes, keys
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        return (mix(keys + salt) >> np.uint64(11)) % np.uint64(size)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, parts, sizes = keys, [np.zeros(0, np.uint64)], []
        while len(left):
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            place = cls._place(left, len(sizes), size).astype(np.int64)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, bool)
            bits[place[alone]] = True
            parts.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone]
        made = cls(np.concatenate(parts), sizes, np.zeros(len(keys), np.uint64))
        made.keys[made._index(keys)] = keys
        return made

    def _index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of foreign keys any index, or -1."""
        out, left, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = self._place(keys[left], level, size)
            word, bit = first + (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            here = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[here], bit[here]
            below = np.bitwise_count(self.bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            out[left[here]] = self.rank[w] + below
            left, first = left[~here], first + size // 64
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for keys that are not in the set."""
        at = self._index(keys)
        if len(self.keys):
            at[self.keys[at] != keys] = -1
        return at


def _shard_bits(keys: int) -> int:
    return max(0, (keys - 1) // SHARD).bit_length()


def _shard(bits: int) -> Column:
    """Shard of a pair: the upper bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64("pair"), 64 - bits).cast("int") if bits else F.lit(0)


_ONLY: dict[type, tuple] = {}


def only(kind: type, *args):
    """The worker's only object of ``kind``, also across tasks; made anew for other arguments."""
    if _ONLY.get(kind, ((), None))[0] != args:
        _ONLY[kind] = args, kind(*args)
    return _ONLY[kind][1]


class Tables:
    """Hashes and vectors of shards, read from the shared folder when first needed."""

    def __init__(self, folder: str):
        self.fs, self.path = opened(folder)
        self.kept: OrderedDict[int, tuple[PerfectHash, np.ndarray | None]] = OrderedDict()
        self.bytes = 0

    def shard(self, no: int) -> tuple[PerfectHash, np.ndarray | None]:
        if no in self.kept:
            self.kept.move_to_end(no)
            return self.kept[no]
        selector = fs.FileSelector(f"{self.path}/shard={no}", allow_not_found=True)
        files = [f.path for f in self.fs.get_file_info(selector) if f.path.endswith(".parquet")]
        if not files:
            return PerfectHash.of(np.zeros(0, np.uint64)), np.zeros(0, np.int64)
        row = pa.concat_tables([pq.ParquetFile(self.fs.open_input_file(f)).read() for f in files]).to_pylist()[0]
        hashed = PerfectHash(np.frombuffer(row["bits"], np.uint64), row["sizes"], np.frombuffer(row["keys"], np.uint64))
        counts = np.frombuffer(row["counts"], np.int64) if "counts" in row else None
        self.kept[no] = hashed, counts
        self.bytes += 24 * len(hashed.keys)
        while self.bytes > CACHE_BYTES and len(self.kept) > 1:
            self.bytes -= 24 * len(self.kept.popitem(last=False)[1][0].keys)
        return hashed, counts


def _added(shards: DataFrame, fan: int) -> DataFrame:
    """One step up the tree: vectors of ``fan`` nodes become one."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in table.column("counts"))
        return pa.table({"shard": table.column("shard")[:1], "node": table.column("node")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    return (shards.withColumn("node", F.expr(f"node div {fan}").cast("int"))
            .groupBy("shard", "node").applyInArrow(add, "shard int, node int, counts binary"))


class PairCounts:
    """Counts of all linked pairs of a corpus: shards of a perfect hash with dense vectors, as files."""

    def __init__(self, spark: SparkSession, folder: str, bits: int):
        self.spark, self.folder, self.bits = spark, folder, bits

    @classmethod
    def of(cls, partial: DataFrame, folder: str) -> PairCounts:
        spark = partial.sparkSession
        pairs = staged(partial.select("pair").distinct(), folder, "pairs")
        keys, rows = pairs.count(), partial.count()
        bits = _shard_bits(keys)

        def build(table: pa.Table) -> pa.Table:
            made = PerfectHash.of(table.column("pair").to_numpy().view(np.uint64))
            return pa.table({"shard": table.column("shard")[:1], "bits": pa.array([made.bits.tobytes()], pa.binary()),
                             "sizes": pa.array([made.sizes], pa.list_(pa.int64())), "keys": pa.array([made.keys.tobytes()], pa.binary())})

        hashed = pairs.withColumn("shard", _shard(bits)).groupBy("shard").applyInArrow(build, INDEX)
        index = f"{folder}/index"
        hashed.write.mode("overwrite").partitionBy("shard").parquet(index)

        leaves = 1          # as many as leave the vectors no emptier than the rows they are made of
        while leaves * FAN * keys < rows:
            leaves *= FAN

        def dense(table: pa.Table) -> pa.Table:
            no = table.column("shard")[0].as_py()
            table_of = only(Tables, index).shard(no)[0]
            vector = np.zeros(len(table_of.keys), np.int64)
            np.add.at(vector, table_of.index(table.column("pair").to_numpy().view(np.uint64)), table.column("n").to_numpy())
            return pa.table({"shard": table.column("shard")[:1], "node": table.column("node")[:1], "counts": pa.array([vector.tobytes()], pa.binary())})

        # It does not matter which rows of a pair meet in which leaf.
        dealt = partial.withColumn("shard", _shard(bits)).withColumn("node", F.pmod(F.monotonically_increasing_id(), F.lit(leaves)).cast("int"))
        sums = dealt.groupBy("shard", "node").applyInArrow(dense, "shard int, node int, counts binary")
        while leaves > 1:
            sums, leaves = _added(sums, FAN), leaves // FAN
        whole = spark.read.schema(INDEX).parquet(index).join(sums.select("shard", "counts"), "shard")
        whole.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/counts")
        return cls(spark, f"{folder}/counts", bits)

    def rows(self) -> DataFrame:
        """(a, b, n) of every pair."""
        schema = "a int, b int, n long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column(0), batch.column(1)):
                    k = np.frombuffer(keys.as_buffer(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)),
                                                      pa.array(np.frombuffer(counts.as_buffer(), np.int64))], names=["a", "b", "n"])

        return self.spark.read.schema(f"{INDEX}, counts binary").parquet(self.folder).select("keys", "counts").mapInArrow(run, schema)

    def highest(self, ids: int) -> np.ndarray:
        """The highest count of each of B's ids: an array as long as B's vocabulary."""
        found = self.rows().groupBy("b").agg(F.max("n").alias("n")).toArrow()
        out = np.zeros(ids, np.int64)
        out[found.column("b").to_numpy()] = found.column("n").to_numpy()
        return out


class Lookup:
    """What a worker of the second pass knows: fragments with the counts of their links."""

    def __init__(self, paths: tuple[str, str], folder: str, bits: int, highest: Broadcast):
        self.aligner, self.bits, self.highest = loaded(Aligner, paths), bits, highest.value
        self.tables = Tables(folder)
        self.fragments = Fragments(self._learn)

    def _counts(self, pairs: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(pairs, return_inverse=True)
        shards = np.zeros(len(distinct), np.int64)
        if self.bits:
            shards = (_xxhash64(distinct) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.zeros(len(distinct), np.int64)
        for no in np.unique(shards).tolist():
            own = np.flatnonzero(shards == no)
            hashed, counts = self.tables.shard(no)
            at = hashed.index(distinct[own].view(np.uint64))
            out[own[at >= 0]] = counts[at[at >= 0]]
        return out[place]

    def _learn(self, new: list[str]) -> dict[str, np.ndarray]:
        found = self.aligner.align(new)
        b = found["b"][found["at_b"]]
        n = self._counts(found["a"][found["at_a"]] << 32 | b)
        best = (n == self.highest[b]).astype(np.int64)
        return {"n_a": found["n_a"], "n_b": found["n_b"], "links": found["links"], "good": found["good"], "best": by_text(best, found["links"]),
                "sum": by_text(n, found["links"]), "groups": np.array(self.aligner.groups(found), object)}

    def rows(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        codes, counts = self.fragments.encode(texts)
        columns = self.fragments.columns
        good = np.fromiter(map(bool, texts), bool, len(texts))
        good &= by_text(~columns["good"][codes], counts) == 0
        numbers = [by_text(columns[c][codes], counts) * good for c in ("n_a", "n_b", "links", "links", "best", "sum")]
        names, stops = columns["groups"][codes].tolist(), np.cumsum(counts).tolist()
        groups = [";".join(names[s:e]) if g else "" for s, e, g in zip([0, *stops], stops, good.tolist())]
        self.fragments.keep()
        return numbers, groups


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _xxhash64(values: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for one long: XXH64 of eight bytes with seed 42."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = (np.array([p], np.uint64) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = p5 + np.uint64(42 + 8)
    h = h ^ _rotl(values.view(np.uint64) * p2, 31) * p1
    h = _rotl(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def corpus_counts(docs: DataFrame, paths: tuple[str, str], text: str = "text", folder: str | None = None) -> PairCounts:
    """Counts of the pairs linked in all ``docs``; ``paths`` name A's file and B's model on every executor."""
    folder = folder or scratch_dir(docs.sparkSession)
    return PairCounts.of(staged(partial_counts(docs, paths, text), folder, "partial"), folder)


def align(docs: DataFrame, paths: tuple[str, str], counts: PairCounts, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row; ``groups`` reads
    ``a1,a2|b1;a3|b2,b3``. ``n_best`` counts links that no other of their B id exceeds in ``counts``."""
    from sentencepiece import SentencePieceProcessor
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(n) for n in names], F.lit("").alias("groups")).schema
    highest = docs.sparkSession.sparkContext.broadcast(counts.highest(SentencePieceProcessor(model_file=paths[1]).vocab_size()))
    folder, bits = counts.folder, counts.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 1):
            lookup = only(Lookup, paths, folder, bits, highest)
            numbers, groups = lookup.rows(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, numbers), pa.array(groups, pa.string())], names=["doc_id", *names, "groups"])

    return rows.mapInArrow(run, schema)
