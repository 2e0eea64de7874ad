"""Queries: chunk packing and splitting by token budget."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docflow.functions.text import register_tiktoken
from docflow.operators import chunking as K
from docflow.schemas import as_chunks
from docflow.session import ensure_checkpoint_dir
from docflow.streaming.incremental import read_latest, run_incremental
from docflow.workload.inputs import SQL_LINES, documents, lines, nested, sql_count, sql_tokens
from docflow.workload.registry import query, stream_path

# Packing in SQL: walk the chunks of each document in order, keeping the start `b` of the open
# buffer and the position `p` in the token stream; every closed range becomes a row.
def _sql_pack(limit: int, overlap: int, source: str) -> str:
    m, v, s = limit, overlap, limit - overlap
    return f"""
counted AS MATERIALIZED (SELECT doc_id, idx, txt, {sql_count('txt')} AS c FROM {source}),
walk AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS p,
         CAST([] AS STRUCT(lo BIGINT, hi BIGINT)[]) AS closed
  FROM counted GROUP BY doc_id
  UNION ALL
  SELECT w.doc_id, w.idx + 1,
    CASE WHEN c.c > {m} THEN w.p + c.c - least({v}, c.c - ceil((c.c - {m}) / {s}::DOUBLE)::BIGINT * {s})
         WHEN w.p - w.b + c.c > {m} AND w.p > w.b THEN greatest(w.b, w.p - {v}) ELSE w.b END,
    w.p + c.c,
    CASE WHEN c.c > {m} THEN
           list_concat(CASE WHEN w.p > w.b THEN [{{'lo': w.b, 'hi': w.p}}] ELSE [] END,
             list_transform(range(0, 1 + ceil((c.c - {m}) / {s}::DOUBLE)::BIGINT),
               lambda i: {{'lo': w.p + i * {s}, 'hi': w.p + least(i * {s} + {m}, c.c)}}))
         WHEN w.p - w.b + c.c > {m} AND w.p > w.b THEN [{{'lo': w.b, 'hi': w.p}}] ELSE [] END
  FROM walk w JOIN counted c ON c.doc_id = w.doc_id AND c.idx = w.idx + 1),
ends AS (SELECT doc_id, max(idx) AS last FROM counted GROUP BY doc_id),
ranges AS (
  SELECT doc_id, idx, unnest(closed) AS r FROM walk
  UNION ALL SELECT w.doc_id, w.idx + 1, {{'lo': b, 'hi': p}} FROM walk w JOIN ends e
    ON w.doc_id = e.doc_id AND w.idx = e.last WHERE w.p > w.b),
stream AS (SELECT doc_id, flatten(list({sql_tokens('txt')} ORDER BY idx)) AS toks FROM counted GROUP BY doc_id),
packed AS (
  SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.idx, r.r.lo) - 1 AS out_idx,
    r.r.hi - r.r.lo AS n_tokens, array_to_string(s.toks[r.r.lo + 1:r.r.hi], '') AS content
  FROM ranges r JOIN stream s USING (doc_id))"""


_SELECT = """SELECT doc_id, CAST(out_idx AS BIGINT) AS out_idx, CAST(n_tokens AS BIGINT) AS n_tokens,
  sha256(content) AS content_hash FROM packed"""


def _shown(df):
    return df.select("doc_id", F.col("chunk_idx").cast("long").alias("out_idx"), F.col("n_tokens").cast("long").alias("n_tokens"),
                     F.sha2("content", 256).alias("content_hash"))


@query("merge_chunks_200", f"WITH RECURSIVE {SQL_LINES}, {_sql_pack(200, 0, 'lines')} {_SELECT}")
def merge_chunks_200(spark, sf):
    return _shown(K.merge_chunks(lines(spark, sf), 200, "lines"))


@query("merge_chunks_overlap", f"WITH RECURSIVE {SQL_LINES}, {_sql_pack(60, 15, 'lines')} {_SELECT}")
def _(spark, sf):
    return _shown(K.merge_chunks(lines(spark, sf), 60, "lines", overlap_tokens=15))


@query("split_oversized", f"""WITH {SQL_LINES},
cut AS (SELECT doc_id, idx, {sql_tokens('txt')} AS toks FROM lines),
pieces AS (SELECT doc_id, idx, toks, unnest(range(greatest(1, ceil(len(toks) / 20.0)::BIGINT))) AS i FROM cut)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx, i) - 1 AS BIGINT) AS out_idx,
  CAST(least(20, len(toks) - i * 20) AS BIGINT) AS n_tokens,
  sha256(array_to_string(toks[i * 20 + 1:(i + 1) * 20], '')) AS content_hash FROM pieces""")
def _(spark, sf):
    return _shown(K.split_oversized(lines(spark, sf), 20, "lines"))


_LISTING = """SELECT doc_id, CAST(out_idx + 1 AS BIGINT) AS chunk_index, 'Document (Part ' || (out_idx + 1) || ')' AS title,
  sha256(content) AS body_hash FROM packed"""


def _listed(df):
    return df.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "title", F.sha2("body", 256).alias("body_hash"))


@query("chunking_job_merge", f"""WITH RECURSIVE
whole AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS idx, text AS txt FROM documents), {_sql_pack(100, 0, 'whole')} {_LISTING}""")
def _(spark, sf):
    docs = documents(spark, sf)
    return _listed(K.chunking_job(docs, lines(spark, sf).limit(0), "merge_and_split", 100))


@query("chunking_job_split", f"""WITH {SQL_LINES}, cut AS (SELECT doc_id, idx, {sql_tokens('txt')} AS toks FROM lines),
packed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, i) - 1 AS out_idx,
  array_to_string(toks[i * 50 + 1:(i + 1) * 50], '') AS content
  FROM (SELECT *, unnest(range(greatest(1, ceil(len(toks) / 50.0)::BIGINT))) AS i FROM cut)) {_LISTING}""")
def _(spark, sf):
    return _listed(K.chunking_job(documents(spark, sf), lines(spark, sf), "split_by_token_count", 50, group="lines"))


@query("incremental_merge", f"WITH RECURSIVE {SQL_LINES}, {_sql_pack(200, 0, 'lines')} {_SELECT}")
def _(spark, sf):
    """The same packing as an incremental run over the files of the documents table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/incremental-{uuid.uuid4().hex}"
    split = lambda df: as_chunks(df.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("lines").alias("chunk_group"),
                                           F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "content")))
    run_incremental(spark, stream_path(sf, "documents"), "doc_id bigint, text string", lambda df: K.merge_chunks(split(df), 200, "lines"),
                    f"{folder}/out", f"{folder}/state")
    return _shown(read_latest(spark, f"{folder}/out"))


@query("chunk_counts", f"""WITH RECURSIVE {SQL_LINES}, {_sql_pack(200, 0, 'lines')},
olds AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id), news AS (SELECT doc_id, count(*) AS n FROM packed GROUP BY doc_id)
SELECT doc_id, CAST(olds.n AS BIGINT) AS old_chunk_count, CAST(coalesce(news.n, 0) AS BIGINT) AS new_chunk_count
FROM olds LEFT JOIN news USING (doc_id)""")
def _(spark, sf):
    old = lines(spark, sf)
    new = K.merge_chunks(old, 200, "lines")
    return K.chunk_counts(old, new, "lines", K.merged_group_name("lines", 200, "words"))


@query("merge_nested_pages", f"WITH RECURSIVE {SQL_LINES}, {_sql_pack(200, 0, 'lines')} {_SELECT}")
def _(spark, sf):
    """Lines of documents that are chunks of master documents: every owner's lines are packed by themselves."""
    _, chunks = nested(spark, sf)
    merged = K.merge_chunks(chunks, 200, "lines")
    return _shown(merged.withColumn("doc_id", F.regexp_replace("owner_id", "_child$", "")))


@query("merge_chunks_bpe")
def _(spark, sf):
    """Packing by the tokens of a byte-pair vocabulary; each line ends in characters of four bytes."""
    import public_tokenizers

    register_tiktoken("byte_bpe_50k", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = lines(spark, sf).withColumn("content", F.concat("content", F.lit(" \U0001d6fc\U0001f600")))
    return _shown(K.merge_chunks(rows, 50, "lines", "byte_bpe_50k"))
