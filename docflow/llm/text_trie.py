"""Copies of texts by compressed tries over ranges of texts.

1. *Adaptive prefixes*: texts are weighed by their first characters, each distinct text once. A prefix that
   weighs more than half a range is lengthened, until it is light or a whole text. The prefixes in
   order, cut by weight, are the borders of the ranges; equal texts always lie in one range.
2. Each task inserts its texts into a trie: edges are byte strings, and the node at the end of a text holds
   the least id met there. Rows with larger ids are copies at once; a full trie is sent on and begun anew.
3. Each range inserts what the tasks have sent, one trie at a time, and its traversal gives the rest of the flags.

Whole texts are compared, byte by byte. A text goes to its range once for each task that has it, not once
for each row, so a text that a third of all rows hold is no larger there than another.

Defined cases: a null text counts as empty; rows of the least id of their text are no copies, however many there
are; a null id is no smaller than any other, so its rows are no copies and make none; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.bpe import byte_slices
from docflow.llm.scratch import staged

FIRST = 8                   # characters of the first prefixes
LONGER = 4                  # factor by which heavy prefixes are lengthened
RANGE_BYTES = 128 << 20     # distinct text of a range, if there are not more partitions anyway
LOCAL_BYTES = 48 << 20      # distinct text a task holds before it sends it on
NODE_BYTES = 400            # what a node costs besides its label
ROWS = 10_000               # rows of an output batch
ABOVE = b"\xff"             # greater than any byte of a text


class Node:
    __slots__ = ("label", "below", "least", "rows")

    def __init__(self, label: bytes):
        self.label, self.below = label, None
        self.least, self.rows = None, None      # rows with the least id: how many of each kind


def shared(label: bytes, text: bytes, at: int) -> int:
    """Bytes that ``label`` and ``text`` from ``at`` on begin with alike."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def node(self, text: bytes) -> Node:
        """The node at the end of ``text``, made if need be."""
        here, at = self.root, 0
        while at < len(text):
            if here.below is None:
                here.below = {}
            child = here.below.get(text[at])
            if child is None:
                child = here.below[text[at]] = Node(text[at:])
                self.bytes += len(text) - at + NODE_BYTES
                return child
            if not text.startswith(child.label, at):
                cut = shared(child.label, text, at)
                upper = here.below[text[at]] = Node(child.label[:cut])
                child.label = child.label[cut:]
                upper.below = {child.label[0]: child}
                self.bytes += NODE_BYTES
                child = upper
            at += len(child.label)
            here = child
        return here

    def insert(self, text: bytes, id, kind: tuple, n: int) -> list[tuple]:
        """Add ``n`` rows; the (id, kind, n) that are now known to be copies."""
        end = self.node(text)
        if end.rows is None or id < end.least:
            copies = [(end.least, k, m) for k, m in end.rows.items()] if end.rows else []
            end.least, end.rows = id, {kind: n}
            return copies
        if id == end.least:
            end.rows[kind] = end.rows.get(kind, 0) + n
            return []
        return [(id, kind, n)]

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """Texts and their nodes."""
        open_nodes = [(b"", self.root)]
        while open_nodes:
            before, node = open_nodes.pop()
            text = before + node.label
            if node.rows:
                yield text, node
            open_nodes.extend((text, child) for child in (node.below or {}).values())


def prefix_borders(texts: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, first: int = FIRST) -> list[bytes]:
    """Lower borders of ranges of texts, ascending: at least as many as shuffle partitions, if the texts differ."""
    spark, partitions = texts.sparkSession, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders, length, heavy, most = [], first, None, None
    while True:
        # Only prefixes, hashes and sizes go into joins and groupings, never the texts.
        rows = texts.select(F.substring("text", 1, length).alias("key"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"),
                            (F.length("text") > length).alias("more"))
        if heavy is not None:
            rows = rows.withColumn("upper", F.substring("key", 1, length // LONGER)).join(heavy.withColumnRenamed("key", "upper"), "upper", "left_semi")
        distinct = rows.groupBy("key", "h").agg(F.max("bytes").alias("bytes"), F.max("more").alias("more"))
        weights = staged(distinct.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.max("more").alias("more")), folder, f"prefixes-{length}")
        total = weights.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        most = most or max(1, min(range_bytes, total // partitions))
        ranges = 4 * max(1, total // most)
        # Prefixes of a part follow each other; parts are joined to ranges in order.
        parts = (weights.where(F.col("bytes") <= most // 2).repartitionByRange(ranges, "key").groupBy(F.spark_partition_id())
                 .agg(F.min("key").alias("key"), F.sum("bytes").alias("bytes")).orderBy("key").collect())
        weight = most
        for part in parts:
            if weight + part["bytes"] > most:
                borders.append(part["key"].encode())
                weight = 0
            weight += part["bytes"]
        heavy = weights.where(F.col("bytes") > most // 2)
        for row in heavy.select("key").collect():
            borders += [row["key"].encode(), row["key"].encode() + ABOVE]
        heavy = heavy.where("more").select("key")
        if heavy.isEmpty():
            return sorted(set(borders))
        length *= LONGER


def copy_flags(rows: DataFrame, kinds: list[str], folder: str, range_bytes: int = RANGE_BYTES, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(doc_id, *kinds, n, copy) for ``rows`` (doc_id, text, *kinds); ``n`` equal rows stand once. ``copy`` is
    true where a row with a smaller id has the same text."""
    spark = rows.sparkSession
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *kinds)
    known = rows.where("doc_id IS NOT NULL")
    shared_borders = spark.sparkContext.broadcast(prefix_borders(known.select("text"), folder, range_bytes))
    flat = known.select("doc_id", *kinds, F.lit(0).cast("long").alias("n"), F.lit(True).alias("copy"))
    sent = known.select(F.lit(0).alias("range"), F.col("text").cast("binary").alias("content"), "doc_id", *kinds, F.lit(0).cast("long").alias("n"))
    for field in [*sent.schema.fields, *flat.schema.fields]:
        field.nullable = True
    out_schema, sent_schema = flat.schema, sent.schema

    def batches_of(found: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        while found:
            some = found[:ROWS]
            del found[:ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, trie, out, turn, types = shared_borders.value, Trie(), [], 0, None
        names = ["range", "content", "doc_id", *kinds, "n"]
        for batch in batches:
            types = [pa.int32(), pa.binary(), batch.schema.field(0).type, *[batch.schema.field(i).type for i in range(2, batch.num_columns)], pa.int64()]
            for s, e in byte_slices(batch.column(1)):
                part = batch.slice(s, e - s)
                ids, texts, *own = (c.to_pylist() for c in part.columns[:1] + [part.column(1).cast(pa.binary())] + part.columns[2:])
                for id, text, kind in zip(ids, texts, zip(*own) if own else [()] * len(ids)):
                    for i, k, n in trie.insert(text, id, kind, 1):
                        turn += 1       # copies go on without their text, to any range
                        out.append((turn % (len(borders) + 1), None, i, *k, n))
                if trie.bytes > local_bytes:
                    yield from leave(trie, borders, out, names, types)
                    trie = Trie()
                yield from batches_of(out, names, types)
        if types:
            yield from leave(trie, borders, out, names, types)
            yield from batches_of(out, names, types)

    def leave(trie: Trie, borders: list[bytes], out: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        size = 0
        for text, node in trie.terminals():
            place = bisect_right(borders, text)
            out.extend((place, text, node.least, *k, n) for k, n in node.rows.items())
            size += len(text) * len(node.rows)
            if size > 4 << 20:
                yield from batches_of(out, names, types)
                size = 0

    def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, here, out, types = Trie(), None, [], None
        names = ["doc_id", *kinds, "n", "copy"]
        for batch in batches:
            types = [*[batch.schema.field(i).type for i in range(2, batch.num_columns)], pa.bool_()]
            for s, e in byte_slices(batch.column(1)):
                part = batch.slice(s, e - s)
                places, texts, ids, *own, counts = (c.to_pylist() for c in part.columns)
                for place, text, id, kind, n in zip(places, texts, ids, zip(*own) if own else [()] * len(ids), counts):
                    if place != here:
                        out.extend((node.least, *k, m, False) for _, node in trie.terminals() for k, m in node.rows.items())
                        trie, here = Trie(), place
                    if text is None:
                        out.append((id, *kind, n, True))
                    else:
                        out.extend((i, *k, m, True) for i, k, m in trie.insert(text, id, kind, n))
                yield from batches_of(out, names, types)
        if types:
            out.extend((node.least, *k, m, False) for _, node in trie.terminals() for k, m in node.rows.items())
            yield from batches_of(out, names, types)

    sent = known.mapInArrow(local, sent_schema).repartition("range").sortWithinPartitions("range")
    nameless = rows.where("doc_id IS NULL").groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.lit(False))
    return sent.mapInArrow(in_ranges, out_schema).unionByName(nameless)
