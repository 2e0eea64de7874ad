"""Texts of any length as rows: a rope.

A rope has a row for every segment of a text: (key, seg, part, total) with ``SEGMENT`` characters in each ``part`` but
the last, and the text's whole length in ``total``. An empty text is one empty part. It has the same form
whether the text came from one cell or from many rows, and whatever its length; spans are cut from it
without ever having the text in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordering import TEXT_CELL_LIMIT, running_before

SEGMENT = 65_536


def rope_of_cells(texts: DataFrame, key: str, text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Rope of texts that are cells: ``texts(key, text)``."""
    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / segment).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * segment + 1, F.lit(segment)))
    return texts.where(F.col(text).isNotNull()).select(key, F.length(text).cast("long").alias("total"), F.posexplode(parts).alias("seg", "part"))


def rope_of_rows(rows: DataFrame, key: str, idx: str, text: str = "text", separator: str = "", segment: int = SEGMENT) -> DataFrame:
    """Rope of texts that lie in rows ``(key, idx, text)``, dense in ``idx``: their texts in order, with ``separator``
    between them. Rows are cut at the borders of segments, so a segment is put together from its own characters only."""
    tail = F.when(F.col(idx) > 0, F.lit(separator)).otherwise("")
    # ``text`` may be a column of the rows under any name.
    glued = rows.select(key, F.col(idx).cast("int").alias("_i"), F.concat(tail, F.coalesce(text, F.lit(""))).alias("_t"))
    placed = running_before(glued, [key], "_i", {"_at": F.length("_t")})
    first, last = F.floor(F.col("_at") / segment), F.floor((F.col("_at") + F.greatest(F.length("_t"), F.lit(1)) - 1) / segment)
    cut = placed.withColumn("seg", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    low = F.greatest(F.col("seg").cast("long") * segment - F.col("_at"), F.lit(0))
    high = (F.col("seg").cast("long") + 1) * segment - F.col("_at")
    piece = F.substring(F.col("_t"), (low + 1).cast("int"), (high - low).cast("int"))
    parts = cut.groupBy(key, "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", piece.alias("t")))),
                                                                lambda x: x["t"]), "").alias("part"))
    totals = glued.groupBy(key).agg(F.sum(F.length("_t")).cast("long").alias("total"))
    # A row of no characters behind the last full segment leaves an empty one.
    return parts.join(totals, key).where((F.col("part") != "") | (F.col("seg") == 0)).select(key, "total", "seg", "part")


def cut_spans(rope: DataFrame, spans: DataFrame, keys: list[str], key: str, segment: int = SEGMENT) -> DataFrame:
    """(*keys, text, reason) of ``spans(*keys, key, start, length)`` over the texts of a rope.

    Spans meet the segments they touch only, so many spans over one long text spread over tasks. ``text`` is NULL
    with reason ``span_out_of_range`` for a span that leaves its text or has none.
    """
    start, end = F.greatest("start", F.lit(0)), F.greatest(F.col("start") + F.col("length"), F.lit(0))
    first = F.floor(F.when(F.col("length") > 0, start).otherwise(F.greatest(start - 1, F.lit(0))) / segment)
    last = F.greatest(first, F.floor((end - 1) / segment))
    touched = spans.withColumn("seg", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    met = touched.join(rope.select(key, "seg", "part", "total"), [key, "seg"], "left")
    lo = F.greatest(F.col("start") - F.col("seg") * segment, F.lit(0))
    hi = F.least(F.col("start") + F.col("length") - F.col("seg") * segment, F.lit(segment))
    part = F.substring(F.col("part"), (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    bad = (F.col("start") < 0) | (F.col("length") < 0) | F.col("total").isNull() | (F.col("start") + F.col("length") > F.col("total"))
    # Cut before grouping, so that no row of a span carries its segment on.
    pieces = met.select(*keys, "seg", part.alias("t"), bad.alias("_out"))
    cut = pieces.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "t"))), lambda x: x["t"]), "").alias("_joined"),
        F.bool_or("_out").alias("_bad"))
    return cut.select(*keys, F.when(~F.col("_bad"), F.col("_joined")).alias("text"), F.when(F.col("_bad"), F.lit("span_out_of_range")).alias("reason"))


def one_cell(rope: DataFrame, key: str, limit: int = TEXT_CELL_LIMIT) -> DataFrame:
    """(key, text, reason): whole texts, for those who ask for one cell. Longer ones than ``limit`` are NULL
    with reason ``text_too_long``; their parts stay in the rope and are not moved."""
    fits = F.col("total") <= limit
    whole = rope.where(fits).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "part"))), lambda x: x["part"]), "").alias("text"))
    long = rope.where(~fits & (F.col("seg") == 0)).select(key, F.lit(None).cast("string").alias("text"), F.lit("text_too_long").alias("reason"))
    return whole.withColumn("reason", F.lit(None).cast("string")).unionByName(long)


def rope_sha256(rope: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of every text of a rope: the SHA-256 of its UTF-8, lowercase hex. A digest is a chain along the text, so
    the parts of one text pass through one task in order; it keeps the digest's state and a batch of parts, never a text."""
    rows = rope.select(key, "seg", "part").repartition(key).sortWithinPartitions(key, "seg").select(key, F.encode("part", "UTF-8").alias("part"))
    schema = rows.select(key, F.lit("").alias("sha256")).schema

    def found(kind: pa.DataType, ended: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in ended], kind), pa.array([d for _, d in ended], pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None
        for batch in batches:
            kind, ended = batch.column(0).type, []
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest is None or k != now:
                    if digest is not None:
                        ended.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256()
                digest.update(part.as_buffer())
            yield found(kind, ended)
        if digest is not None:
            yield found(kind, [(now, digest.hexdigest())])

    return rows.mapInArrow(run, schema)
