"""A training corpus from ``documents``, in stages: drop toxic texts, exact and near copies and leaked
benchmark items, then encode what is left.

Each stage reads what the one before it wrote. A row is named by its id and a hash of its text, so ids
may be null or repeat; of equal rows (same id, same text) one is left after the exact copies.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import toxicity
from docflow.llm.bpe import round_trip
from docflow.llm.decontam import contaminated
from docflow.llm.exact_dedup import distinct_texts
from docflow.llm.jaccard_tree import near_classes
from docflow.llm.queries import id_fold
from docflow.llm.scratch import scratch_dir, staged

SHINGLE, PERCENT = 5, 80        # words of a shingle and similarity of near copies
TOKENIZER = "byte_bpe_50k.json"


def _row() -> Column:
    """What names a row: its id and a hash of its text."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(_row().alias("doc_id"), "text")


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the rows named by ``rows.doc_id``."""
    right = rows.select(F.col("doc_id.id").alias("right_id"), F.col("doc_id.h").alias("right_h")).distinct()
    same = docs["doc_id"].eqNullSafe(right["right_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == right["right_h"])
    return docs.join(right, same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels, id_fold(5) != 0))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the largest id."""
    return distinct_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row with the least id stays."""
    classes = near_classes(_named(docs), n=SHINGLE, percent=PERCENT)
    return _joined(docs, classes.where(F.col("doc_id") == F.col("component_id")), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _joined(docs, contaminated(_named(docs), items), "left_anti")


def encode_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document."""
    path = public_tokenizers.path(TOKENIZER)
    return round_trip(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks), ("bpe", encode_corpus)]

# A trained classifier decides in the first stage, which SQL cannot say.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
