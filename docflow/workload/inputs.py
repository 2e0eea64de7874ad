"""The given tables in the shape of the engine's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.content import combine_documents
from docflow.operators.tree import path_of
from docflow.schemas import as_chunks, as_docs
from docflow.workload.registry import table


def documents(spark: SparkSession, sf_dir: str, metadata: bool = False) -> DataFrame:
    """``documents`` as docs; lang and source become metadata on request."""
    df = table(spark, sf_dir, "documents")
    meta = F.to_json(F.struct("lang", "source")) if metadata else F.lit(None)
    return as_docs(df.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"),
                             meta.cast("string").alias("metadata")))


def lines(spark: SparkSession, sf_dir: str, metadata: bool = False) -> DataFrame:
    """Lines of every document as chunk group ``lines``."""
    df = table(spark, sf_dir, "documents")
    rows = df.select(F.col("doc_id").cast("string").alias("doc_id"), "lang",
                     F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "content"))
    meta = F.to_json(F.struct(F.col("chunk_idx").alias("line"), "lang")) if metadata else F.lit(None)
    return as_chunks(rows.select(
        "doc_id", F.lit("lines").alias("chunk_group"), "chunk_idx",
        F.concat("doc_id", F.lit("/lines@"), F.col("chunk_idx").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("parent"), "content", meta.cast("string").alias("metadata"), F.lit(1).alias("depth")))


def nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A master document for every source, with its documents as chunks ``sources`` and their lines as chunks of these."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"), "source")
    masters, members = combine_documents(rows, "source", "n")
    inner = members.select("doc_id", "master_id", "child_id", F.col("chunk_idx").alias("place"))
    top = members.select(F.col("master_id").alias("doc_id"), "chunk_group", "chunk_idx", F.col("child_id").alias("chunk_id"),
                         F.col("master_id").alias("parent"), F.lit(1).alias("depth"), F.lit("lines").alias("content_chunk_group"))
    # Only texts and their places are joined; all else is made of these behind the join.
    below = lines(spark, sf_dir).select("doc_id", "chunk_idx", "content").join(inner, "doc_id").select(
        F.col("master_id").alias("doc_id"), path_of(F.lit(""), F.lit("sources"), F.col("place")).alias("owner"), F.col("child_id").alias("owner_id"),
        F.lit("lines").alias("chunk_group"), "chunk_idx", F.concat("doc_id", F.lit("/lines@"), F.col("chunk_idx").cast("string")).alias("chunk_id"),
        F.col("child_id").alias("parent"), "content", F.lit(2).alias("depth"))
    return as_docs(masters), as_chunks(top).unionByName(as_chunks(below))


# Lines in SQL: doc_id, idx (from 0), txt, and the number of lines n.
SQL_LINES = """lines AS (
  SELECT doc_id, lang, unnest(range(len(s))) AS idx, unnest(s) AS txt, len(s) AS n
  FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, string_split(text, chr(10)) AS s FROM documents))"""

SQL_TOKEN = r"'[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+$'"


def sql_tokens(col: str) -> str:
    return f"regexp_extract_all({col}, {SQL_TOKEN})"


def sql_count(col: str) -> str:
    return f"len({sql_tokens(col)})"
