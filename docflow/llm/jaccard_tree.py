"""Near-duplicate classes of documents by the Jaccard similarity of their word n-grams.

Each document is the set of its distinct shingles, as 64-bit hashes. Equal sets are one class from
the start. Two different sets with at least the wanted similarity share a shingle among the first
few of each in any fixed order, so only classes that share such a *key* are compared:

1. Keys. The order is by the frequency class of a shingle's rarest word, then by hash: rare shingles
   come first, lines that many documents share come last. Any order is right, so the list of frequent
   words that makes it may be bounded.
2. *First links*: each class is compared with the anchors of its keys (their classes with the least
   id) and its neighbours in size, as far as it shares most keys with them.
   Groups of near copies mostly become one component here, without comparing all pairs.
3. *Signature trees* find all other links. Classes that share a key share its anchor, so below each anchor
   whose classes lie in several components there are trees over their signatures. Every node holds the OR of its
   members' token bitmaps and the range of their sizes. Two nodes are visited together, from the root down; a
   pair of nodes is left if no two members can share enough shingles, if the size ranges are too far apart, or if
   both lie in one component already. A first traversal by signatures finds the members that may be similar to
   another one; only these get their full sets, and in a second one pairs of leaves are compared on the spot. Only
   links that join two components there are sent on, fewer than there are members.
4. Components of all links.

The classes below an anchor are cut into cells of at most ``CELL`` classes on each side.

Defined cases: null texts and texts without words have an empty set, which links with nothing; a
text with fewer words than a shingle is one shingle; a null id does not count for the least id of a
component, which is null if all its ids are; ids may repeat; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.bits import bit_filter, in_filter
from docflow.llm.bpe import give_back
from docflow.llm.components import components
from docflow.llm.scratch import scratch_dir, staged
from docflow.llm.words import chunks, grams, mix, word_hashes

FREQUENT = 1 << 16      # words whose frequency class is known; all others count as rare
LOCAL = 4               # occurrences in a part of the texts from which a word may be frequent
PART_WORDS = 8_000_000
CELL = 512
LIKELY = 2              # neighbours a class is compared with before the trees
FANOUT = 8
BITS = 1024             # bits of the signature of a set of up to PER shingles; twice as many for twice the size
PER = 512
SMALL = 16              # members up to which a tree is a single node
PLACE = ["anchor", "cell_a", "cell_b"]
FILTER_BITS = 26
CHUNK = 2_000_000


class WordClasses:
    """Frequency class of frequent words; 0 for all others."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words = words[order]
        self.classes = np.log2(np.maximum(counts[order], 1)).astype(np.uint8)

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.uint8)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.classes[at], np.uint8(0))


def shingle_sets(texts: list[bytes], n: int, classes: WordClasses | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and the class of each shingle; A-Z count as a-z."""
    words, counts = word_hashes([t.lower() for t in texts])
    tags = mix(grams(words, n)) if len(words) >= n else np.zeros(0, np.uint64)
    rare = np.zeros(len(words), np.uint8) if classes is None else classes.of(words)
    least = rare[:len(tags)].copy()
    for k in range(1, n):
        np.minimum(least, rare[k:k + len(tags)], out=least)
    sets, kinds, at = [], [], 0
    for count in counts.tolist():
        if count >= n:
            s, first = np.unique(tags[at:at + count - n + 1], return_index=True)
            sets.append(s)
            kinds.append(least[at + first])
        else:
            sets.append(mix(grams(words[at:at + count], count) + np.uint64(count)) if count else np.zeros(0, np.uint64))
            kinds.append(np.zeros(len(sets[-1]), np.uint8))
        at += count
    return sets, kinds


def key_count(size: int, percent: int) -> int:
    """First shingles of a set of ``size`` among which a similar set must have one too."""
    return size - (size * percent + 99) // 100 + 1


def keys_of(s: np.ndarray, kinds: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set: lowest classes first, then least hashes."""
    return s[np.argsort(kinds, kind="stable")[:key_count(len(s), percent)]]


def level_of(size: int) -> int:
    """Signatures of level k have BITS * 2^k bits."""
    return max(0, (size - 1) // PER).bit_length()


def signature(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS << level_of(len(s)), bool)
    bits[(s >> np.uint64(20)).astype(np.int64) % len(bits)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def at_level(signatures: list[bytes], level: int) -> np.ndarray:
    """Signatures as rows of one matrix, longer ones folded to the length of ``level``."""
    words = (BITS << level) // 64
    flat = b"".join(signatures)
    if len(flat) == 8 * words * len(signatures):
        return np.frombuffer(flat, np.uint64).reshape(-1, words)
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0) for x in signatures])


def _word_classes(rows: DataFrame) -> WordClasses:
    """The most frequent words of the corpus. Words must repeat within a part of the texts to be sent on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words[n >= LOCAL].view(np.int64)), pa.array(n[n >= LOCAL])], names=["word", "n"])

        for _, texts in chunks(batches, 0, CHUNK):
            held.append(word_hashes([t.lower() for t in texts])[0])
            if sum(map(len, held)) > PART_WORDS:
                yield counted()
        if held:
            yield counted()

    top = (rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow())
    return WordClasses(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy())


def _sets_by_row(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, size, digest, keys, bits, h); h is a hash of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(_word_classes(rows))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("size"), F.lit(b"").alias("digest"), F.array().cast("array<long>").alias("keys"), F.lit(b"").alias("bits"), F.lit(0).cast("long").alias("h")).schema
    for field in schema.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 1, CHUNK):
            sets, kinds = shingle_sets(texts, n, shared.value)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            keys = [keys_of(s, k, percent) if len(s) else s for s, k in zip(sets, kinds)]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                 pa.array(text_hashes(texts).view(np.int64))], names=["doc_id", "size", "digest", "keys", "bits", "h"])

    return rows.mapInArrow(run, schema)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def text_hashes(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def _sets_of(rows: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the classes in ``wanted`` (digest, node, h), from texts whose hash may be one of them."""
    known = rows.sparkSession.sparkContext.broadcast(bit_filter(wanted, F.col("h"), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for _, texts in chunks(batches, 0, CHUNK):
            maybe = np.flatnonzero(in_filter(known.value, text_hashes(texts))).tolist()
            sets = [s for s in shingle_sets([texts[i] for i in maybe], n)[0] if len(s)]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            # Copies in one task are sent once; what was sent is forgotten before it gets large.
            sent = set() if len(sent) > 100_000 else sent
            own = [i for i, d in enumerate(digests) if d not in sent and not sent.add(d)]
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in own], pa.binary()), pa.array([sets[i].tobytes() for i in own], pa.binary())],
                                             names=["digest", "shingles"])

    found = rows.select("text").mapInArrow(run, "digest binary, shingles binary")
    # The join deals by digest, which is what the aggregation needs.
    return (found.join(wanted.select("digest", "node"), "digest").groupBy("digest")
            .agg(F.first("node").alias("node"), F.first("shingles").alias("shingles")).drop("digest"))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that sizes and signatures do not rule out."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("size").alias(f"n{name}"), F.col("bits").alias(f"b{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ba", "bb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            low = np.fromiter(map(level_of, np.minimum(n, m).tolist()), np.int64, len(n))
            near = (100 * n >= percent * m) & (100 * m >= percent * n)
            good = np.zeros(len(n), bool)
            for level in np.unique(low[near]).tolist():
                at = np.flatnonzero(near & (low == level))
                x, y = (at_level([c[i].as_py() for i in at.tolist()], level) for c in (batch.column(4), batch.column(5)))
                # A bit that only one of the two has stands for at least one shingle of its own.
                most = np.minimum(n[at] - np.bitwise_count(x & ~y).sum(axis=1), m[at] - np.bitwise_count(y & ~x).sum(axis=1))
                good[at] = (100 + percent) * most >= percent * (n[at] + m[at])
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def _verified(rows: DataFrame, n: int, pairs: DataFrame, classes: DataFrame, percent: int, folder: str) -> DataFrame:
    """Links (a, b) among ``pairs``: those similar enough by their full sets."""
    pairs = staged(_possible(pairs, classes, percent), folder, "pairs")
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = staged(_sets_of(rows, n, classes.join(nodes, "node", "left_semi").select("digest", "node", "h")), folder, "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                good.append(similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return staged(both.mapInArrow(run, "a long, b long"), folder, "links")


class Tree:
    """Signature tree over members sorted by size: levels of nodes with OR bitmaps and ranges."""

    def __init__(self, node: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        order = np.argsort(size, kind="stable")
        self.node = node[order]
        size, comp, bits = size[order], comp[order], bits[order]
        excess = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        # Of each level: least and largest size, OR of the bitmaps, most shingles hidden behind a
        # shared bit, least and largest component.
        self.levels = [(size, size, bits, excess, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, b, e, c, d = self.levels[-1]
            cut = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.bitwise_or.reduceat(b, cut, axis=0),
                                np.maximum.reduceat(e, cut), np.minimum.reduceat(c, cut), np.maximum.reduceat(d, cut)))

    def possible(self, other: Tree, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """False where no member of node x of this tree can be similar enough to one of node y of the other."""
        lo, hi, b, e, c, d = self.levels[min(level, len(self.levels) - 1)]
        lo2, hi2, b2, e2, c2, d2 = other.levels[min(level, len(other.levels) - 1)]
        shared = np.bitwise_count(b[x] & b2[y]).sum(axis=1).astype(np.int64) + np.minimum(e[x], e2[y])
        enough = (100 + percent) * shared >= percent * (lo[x] + lo2[y])
        near = (100 * hi[x] >= percent * lo2[y]) & (100 * hi2[y] >= percent * lo[x])
        joined = (c[x] == d[x]) & (c2[y] == d2[y]) & (c[x] == c2[y])
        return enough & near & ~joined


def tree_pairs(one: Tree, two: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Members (as positions) of the two trees that may be similar; each pair once if both are one tree."""
    level = max(len(one.levels), len(two.levels)) - 1
    x = y = np.zeros(1, np.int64)
    while True:
        keep = one.possible(two, level, x, y, percent)
        x, y = x[keep], y[keep]
        if level == 0 or not len(x):
            return x, y
        level -= 1
        grown = []
        for tree, parent in ((one, x), (two, y)):
            if level >= len(tree.levels) - 1:       # the shorter tree waits at its root
                grown.append((parent, np.ones(len(parent), np.int64)))
            else:
                first = parent * FANOUT
                grown.append((first, np.minimum(first + FANOUT, len(tree.levels[level][0])) - first))
        (fx, nx), (fy, ny) = grown
        total = nx * ny
        pair = np.repeat(np.arange(len(x)), total)
        k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        x, y = fx[pair] + k // ny[pair], fy[pair] + k % ny[pair]
        if one is two:
            keep = x <= y
            x, y = x[keep], y[keep]
            if level == 0:
                x, y = x[x != y], y[x != y]


def _candidates(side: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of a cell that may be similar: side 0 with side 1 if there is one, else all with all."""
    crossed = side.any()
    if crossed and side.all():
        return
    if len(size) <= SMALL:
        x, y = np.triu_indices(len(size), 1)
        keep = (comp[x] != comp[y]) & (100 * size[x] >= percent * size[y]) & (100 * size[y] >= percent * size[x])
        keep &= (side[x] != side[y]) | (not crossed)
        x, y = x[keep], y[keep]
        for level in range(level_of(int(size.max())) + 1) if len(x) else ():
            own = np.flatnonzero(np.fromiter(map(level_of, np.minimum(size[x], size[y]).tolist()), np.int64, len(x)) == level)
            a, b = (at_level([bits[i] for i in k[own].tolist()], level) if len(own) else np.zeros((0, 1), np.uint64) for k in (x, y))
            # A bit that only one of the two has stands for at least one shingle of its own.
            n, m = size[x[own]], size[y[own]]
            most = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1), m - np.bitwise_count(b & ~a).sum(axis=1))
            good = own[(100 + percent) * most >= percent * (n + m)]
            yield x[good], y[good]
        return
    most, least = (np.fromiter(map(level_of, n.tolist()), np.int64, len(n)) for n in (size, -(-size * percent // 100)))
    # A set meets those of all levels in which one of them may be large enough.
    for level in np.unique(most).tolist():
        own = np.flatnonzero((least <= level) & (level <= most))
        rows = at_level([bits[i] for i in own.tolist()], level)
        trees = [Tree(own[m], size[own[m]], comp[own[m]], rows[m]) for m in ((side[own] == 0, side[own] == 1) if crossed else [side[own] == 0])]
        if all(len(t.node) for t in trees):
            x, y = tree_pairs(trees[0], trees[-1], percent)
            yield trees[0].node[x], trees[-1].node[y]


def cell_members(side: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """True for the members of a cell that may be similar to another one."""
    out = np.zeros(len(size), bool)
    for x, y in _candidates(side, size, comp, bits, percent):
        out[x] = out[y] = True
    return out


def cell_links(side: np.ndarray, node: np.ndarray, size: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links (nodes) of a cell that join two of its components: fewer than it has members."""
    up = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    comps = comp.tolist()
    for x, y in _candidates(side, size, comp, [signature(s).tobytes() for s in sets], percent):
        for i, j in zip(x.tolist(), y.tolist()):
            a, b = top(comps[i]), top(comps[j])
            if a != b and similar(sets[i], sets[j], percent):
                up[a] = b
                yield int(node[i]), int(node[j])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    here = None
    for batch in batches:
        ids = [batch.column(c).to_numpy() for c in PLACE]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([i[1:] != i[:-1] for i in ids], axis=0)
        starts = np.flatnonzero(new).tolist()
        for s, e in zip(starts, [*starts[1:], batch.num_rows]):
            at = tuple(int(i[s]) for i in ids)
            if held and at != here:
                yield pa.Table.from_batches(held)
                held = []
            here = at
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _in_cells(cells: DataFrame) -> DataFrame:
    return cells.repartition(*PLACE).sortWithinPartitions(*PLACE)


def _possible_members(cells: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``cells`` whose class may be similar to another one of its cell, by their signatures."""
    names = [*PLACE, "side", "node", "size", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        kept: list[pa.RecordBatch] = []
        for cell in _by_cell(batches):
            if cell.num_rows > 1:
                side, size, comp = (cell.column(c).to_numpy() for c in ("side", "size", "comp"))
                found = cell_members(side, size, comp, cell.column("bits").to_pylist(), percent)
                if found.any():
                    kept += cell.select(names).filter(pa.array(found)).to_batches()
            if len(kept) > 500:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept = []
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    return _in_cells(cells.join(classes.select("node", "bits"), "node").select(*names, "bits")).mapInArrow(run, cells.select(names).schema)


def _by_trees(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from the members of cells, with their full sets: each cell sends only what joins two components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        links: list[tuple[int, int]] = []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for cell in _by_cell(batches):
            side, node, size, comp = (cell.column(c).to_numpy() for c in ("side", "node", "size", "comp"))
            own = [np.frombuffer(v.as_buffer(), np.uint64) for v in cell.column("shingles")]
            links.extend(cell_links(side, node, size, comp, own, percent))
            if len(links) > 10_000:
                yield sent()
                links.clear()
        yield sent()

    dealt = _in_cells(cells.join(sets, "node").select(*PLACE, "side", "node", "size", "comp", "shingles"))
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _cells(shared: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """Members of the trees. Classes that share a key also share its anchor, so trees stand below anchors, each class once.
    Below every anchor that spans components, the largest component (side 0) meets the others (side 1), and the
    others meet each other; each side of a meeting is cut into cells of about ``CELL`` members."""
    member = (shared.select("anchor", "node", "size").distinct().join(roots, "node", "left")
              .select("anchor", "node", "size", F.coalesce("root", "node").alias("comp")))
    member = staged(member, folder, "members")
    counts = member.groupBy("anchor", "comp").agg(F.count(F.lit(1)).alias("n"))
    by_anchor = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    cut = lambda n: F.ceil(n / CELL).cast("int")
    split = by_anchor.where("comps > 1").select("anchor", F.col("top.comp").alias("top"), cut(F.col("top.n")).alias("ga"),
                                                cut(F.col("n") - F.col("top.n")).alias("gb"))
    rows = staged(member.join(split, "anchor"), folder, "spanning")
    place = lambda g: F.pmod(F.xxhash64("node"), g).cast("int")
    upto = lambda g: F.sequence(F.lit(0), g - 1)
    out = [*PLACE, "side", "node", "size", "comp"]
    tops, rest = rows.where("comp = top"), rows.where("comp <> top")
    meets = [tops.select("*", place(F.col("ga")).alias("cell_a"), F.explode(upto(F.col("gb"))).alias("cell_b"), F.lit(0).alias("side")),
             rest.select("*", F.explode(upto(F.col("ga"))).alias("cell_a"), place(F.col("gb")).alias("cell_b"), F.lit(1).alias("side"))]
    # Among the rest: cell (-1 - i, j) for i <= j; a member of cell i is side 0 where it is the smaller one.
    own = rest.select("*", place(F.col("gb")).alias("p"), F.explode(upto(F.col("gb"))).alias("q"))
    meets.append(own.select("*", (-1 - F.least("p", "q")).alias("cell_a"), F.greatest("p", "q").alias("cell_b"),
                            F.when(F.col("p") <= F.col("q"), 0).otherwise(1).alias("side")))
    union = meets[0].select(out)
    for m in meets[1:]:
        union = union.unionByName(m.select(out))
    return staged(union, folder, "cells")


def near_classes(docs: DataFrame, n: int = 3, percent: int = 90, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row, for a ``percent`` of 1 to 100."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not 1 to 100")
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets_by_row = staged(_sets_by_row(rows, n, percent), folder, "rows")
    classes = (sets_by_row.where("size > 0").groupBy("digest")
               .agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("size", "keys", "bits", "h")]))
    # The number of a class is written once, so it stays the same whatever is computed again later.
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), folder, "classes")

    keys = classes.select("node", "size", "least", F.explode("keys").alias("key"))
    # The anchor of a key is its class with the least id: of a text and its copies, mostly the text.
    crowd = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("least", "node")).alias("a"))
             .where("n > 1").select("key", "n", F.col("a.node").alias("anchor")))
    shared = staged(keys.drop("least").join(crowd, "key"), folder, "shared")

    # First links: anchors; neighbours in size, in parts of about CELL classes; the parts' first members.
    parted = shared.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CELL)).cast("int"))
    before = lambda w: F.lag("node").over(w)
    inner = parted.select("node", before(Window.partitionBy("key", "part").orderBy("size", "node")).alias("a"))
    heads = (parted.where(F.col("n") > CELL).groupBy("key", "part").agg(F.min(F.struct("size", "node")).alias("h"))
             .select("key", "h.size", "h.node"))
    outer = heads.select("node", before(Window.partitionBy("key").orderBy("size", "node")).alias("a"))
    anchors = shared.where("node <> anchor").select("node", F.col("anchor").alias("a"))
    votes = inner.unionByName(outer).unionByName(anchors).where("a IS NOT NULL").groupBy("node", "a").agg(F.count(F.lit(1)).alias("votes"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("votes"), "a"))
    likely = votes.withColumn("r", best).where(F.col("r") <= LIKELY).select("a", F.col("node").alias("b"))
    first = _verified(rows, n, likely, classes, percent, f"{folder}/first")
    roots = components(first, f"{folder}/first")

    cells = staged(_possible_members(_cells(shared, roots, folder), classes, percent), folder, "possible")
    wanted = cells.select("node").distinct()
    sets = staged(_sets_of(rows, n, classes.join(wanted, "node", "left_semi").select("digest", "node", "h")), folder, "tree-sets")
    links = first.unionByName(staged(_by_trees(cells, sets, percent), folder, "tree-links"))
    roots = components(links, f"{folder}/trees")

    rooted = classes.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = staged(rooted.join(least, "root").select("digest", "component"), folder, "named")
    return (sets_by_row.select("doc_id", "size", "digest").join(named, "digest", "left")
            .select("doc_id", F.col("size").alias("n_shingles"),
                    F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")))
