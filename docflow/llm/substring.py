"""Substring dedup: word windows that also start earlier in the corpus are removed.

Windows are compared by hash, after a filter by prefix, in place of suffix trees: no tree and no maximal
repeat is built. Only groups that can still hold a repeat go on, and none has to fit into one task:

1. *Prefix of ``SEED`` words.* Of the suffixes that start inside a window only one is followed: the
   one whose first ``SEED`` words have the least hash. Equal windows follow equal suffixes, so
   nothing is lost, and neighbouring windows mostly share theirs. Prefixes are counted over the whole
   corpus; those that occur once repeat nothing and end here.
2. *Group of the whole stretch* (all windows that follow one suffix, 20 to 32 words). Rows of a group
   are merged map-side; all but its earliest row repeat earlier text with every window.
3. *Groups of the window length.* The earliest rows of the groups below one prefix are opened into
   single windows; a window that is not the earliest of its group repeats earlier text.

Groups are named by two 64-bit hashes of their words (prefix, stretch or window). The bit filter that
keeps once-only prefixes out of step 2 has a fixed size; a full filter only lets more rows through,
which step 2 then finds to be alone.

Defined cases: a null or short text has no window and loses nothing; a null id comes before all
others; rows with one id and different texts are ordered by a hash of the text, equal rows do not
repeat each other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.bits import bit_filter, in_filter
from docflow.llm.scratch import scratch_dir, staged
from docflow.llm.words import chunks, grams, mix, word_hashes

WINDOW = 20
SEED = 8
FILTER_BITS = 28
CHUNK = 2_000_000


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the (leftmost) least of each ``width`` values in a row, by doubling."""
    have, at = values, np.arange(len(values))
    span = 1
    while span < width:
        shift = min(span, width - span)
        m = len(have) - shift
        right = have[shift:] < have[:m]
        have, at = np.where(right, have[shift:], have[:m]), np.where(right, at[shift:], at[:m])
        span += shift
    return at


def stretches(texts: list[bytes], window: int = WINDOW, seed: int = SEED) -> dict[str, np.ndarray]:
    """Runs of windows of one text that follow the same suffix.

    text, start (word), count (windows), prefix, stretch (hashes); windows (hashes of all windows of
    all runs, one run behind the other).
    """
    words, counts = word_hashes(texts)
    if len(words) < window:
        none = np.zeros(0, np.uint64)
        return {"text": none.astype(np.int64), "start": none.astype(np.int32), "count": none.astype(np.int32),
                "prefix": none, "stretch": none, "windows": none}
    whole = mix(grams(words, window))
    prefix = mix(grams(words, seed))
    followed = least_in_window(prefix, window - seed + 1)
    firsts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(texts)), counts)[:len(whole)]
    inside = np.flatnonzero(np.arange(len(whole)) + window <= (firsts + counts)[text])
    new = np.ones(len(inside), bool)
    new[1:] = followed[inside[1:]] != followed[inside[:-1]]
    heads = inside[new]
    count = np.diff(np.append(np.flatnonzero(new), len(inside)))
    at = followed[heads]
    tails = heads + count - 1
    stretch = mix(whole[heads] * np.uint64(3) + mix(whole[tails] + (count * 64 + at - heads).astype(np.uint64)))
    return {"text": text[heads], "start": (heads - firsts[text[heads]]).astype(np.int32), "count": count.astype(np.int32),
            "prefix": prefix[at], "stretch": stretch, "windows": whole[inside]}


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _prefixes(rows: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, 0, CHUNK):
            yield pa.RecordBatch.from_arrays([_signed(stretches(texts, window, seed)["prefix"])], names=["prefix"])
    return rows.select("text").mapInArrow(run, "prefix long")


def _repeated_filter(rows: DataFrame, window: int, seed: int, bits: int) -> np.ndarray:
    """A bit for every prefix that occurs more than once."""
    repeated = _prefixes(rows, window, seed).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bit_filter(repeated, F.col("prefix"), bits)


def repeated_stretches(docs: DataFrame, window: int = WINDOW, seed: int = SEED, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, h, first, last): windows ``first`` … ``last`` of a row repeat earlier text; h is xxhash64 of the text."""
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    bits = spark.sparkContext.broadcast(_repeated_filter(docs, window, seed, filter_bits))
    schema = docs.select("doc_id", "h", *[F.lit(0).cast(kind).alias(name) for name, kind in (
        ("start", "int"), ("count", "int"), ("prefix", "long"), ("stretch", "long"))], F.lit(b"").alias("windows")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for part, texts in chunks(batches, 2, CHUNK):
            s = stretches(texts, window, seed)
            keep = in_filter(known, s["prefix"])
            ends = np.append(0, np.cumsum(s["count"][keep])).astype(np.int32) * 8
            data = s["windows"][np.repeat(keep, s["count"])].tobytes()
            windows = pa.Array.from_buffers(pa.binary(), int(keep.sum()), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            at = pa.array(s["text"][keep])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(s["start"][keep]), pa.array(s["count"][keep]),
                 _signed(s["prefix"][keep]), _signed(s["stretch"][keep]), windows], names=schema.names)

    rows = staged(docs.select("doc_id", "h", "text").mapInArrow(run, schema), folder, "stretches")
    place = F.struct("doc_id", "h", "start")
    nodes = rows.groupBy("prefix", "stretch").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n"))
    nodes = staged(nodes, folder, "nodes")
    branching = nodes.groupBy("prefix").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("prefix")
    # Later copies of a whole stretch. The windows stay out of this join.
    late = (rows.drop("windows").join(nodes.where("n > 1"), ["prefix", "stretch"]).where(place != F.col("earliest"))
            .select("doc_id", "h", F.col("start").alias("first"), (F.col("start") + F.col("count") - 1).alias("last")))
    # The earliest stretch of each node below a branching prefix, window by window.
    heads = nodes.join(branching, "prefix", "left_semi").select("prefix", "earliest.*")
    same = [rows[c].eqNullSafe(heads[c]) for c in ("prefix", "doc_id", "h", "start")]
    opened = (rows.join(heads, same[0] & same[1] & same[2] & same[3], "left_semi")
              .select("doc_id", "h", "start", "prefix", F.col("windows"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"))
              .select("doc_id", "h", (F.col("start") + F.col("k")).alias("start"), "prefix",
                      F.substring("windows", F.col("k") * 8 + 1, F.lit(8)).alias("window")))
    opened = staged(opened, folder, "windows")
    first = opened.groupBy("prefix", "window").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = (opened.join(first, ["prefix", "window"]).where(place != F.col("earliest"))
              .select("doc_id", "h", F.col("start").alias("first"), F.col("start").alias("last")))
    return staged(late.unionByName(single), folder, "repeats")


def drop_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: str = "text", doc_id: str = "doc_id",
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row; ``kept`` is the remaining words joined by one space."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = repeated_stretches(rows, window, seed, filter_bits)
    # A document has at most as many rows here as words.
    spans = found.groupBy(F.col("doc_id").alias("sid"), F.col("h").alias("sh")).agg(
        F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("h") == F.col("sh")), "left").select(
        "doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))
    schema = joined.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 1, CHUNK):
            n_words, n_removed, kept = [], [], []
            for raw, first, last in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = raw.split()
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, np.array(first or [], np.int64), 1)
                np.add.at(gone, np.array(last or [], np.int64) + window, -1)
                stay = np.cumsum(gone[:-1]) == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join(words if not first else [words[i] for i in np.flatnonzero(stay).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=schema.names)

    return joined.mapInArrow(run, schema)
