"""Exact dedup by skew-safe combining.

1. *Local*: every task merges its equal texts (the map side of the first aggregation).
2. *Salted*: the local winners of a digest meet in ``salts`` groups, so a text that makes up a
   third of all rows is merged in many tasks.
3. *Global*: the salt winners of a digest, at most ``salts`` rows per text, are combined.

The text is part of the grouping key in each step, so full contents are compared, not only digests.
``distinct_texts`` leaves exactly one row of each text, also where the largest id repeats or all ids are null.

Defined cases: a null text equals the empty text; a null id is smaller than any other, and an id may
repeat (each of its rows is returned, and each equals the keep_id if one does); an empty table gives
an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.scratch import scratch_dir, staged


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 32,
                digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per distinct text: (digest, text, keep_id, group_size)."""
    rows = (docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .select("id", "text", digest(F.col("text")).alias("digest"),
                    (F.spark_partition_id() % salts).alias("salt")))
    salted = (rows.groupBy("digest", "salt", "text")
              .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    # Dealt by digest alone, so that the texts of one digest can be counted without another shuffle.
    return (salted.drop("salt").repartition(F.col("digest")).groupBy("digest", "text")
            .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 32,
                digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """All rows and columns of ``docs`` plus ``keep_id``, ``group_size`` and ``kept``.

    Of equal texts the row with the largest id is kept. ``docs`` columns of those three names are
    replaced. Texts of different content with one digest (a parameter, so tests use a poor one) are
    told apart by content: their rows take a join on digest and text.
    """
    folder = scratch_dir(docs.sparkSession)
    groups = text_groups(docs, text, doc_id, salts, digest)
    per_digest = staged(groups.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        .where("texts > 1 OR group_size > 1"), folder, "repeated")
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept")]
    # Own names inside, so that no column of the input can clash and unused ones are pruned.
    packed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)],
                         F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).alias("id"))
    keyed = packed.withColumn("digest", digest(F.col("text")))
    found = [*[f"c{i}" for i in range(len(own))], "id", "keep_id", "group_size"]
    clashes = per_digest.where("texts > 1")
    if clashes.isEmpty():
        decided = keyed.drop("text").join(per_digest, "digest", "left").select(*found)
    else:
        by_text = staged(groups.join(clashes.select("digest"), "digest", "left_semi"), folder, "clashes")
        plain = keyed.join(clashes.select("digest"), "digest", "left_anti").join(per_digest, "digest", "left")
        decided = (plain.select(*found)
                   .unionByName(keyed.join(by_text, ["digest", "text"]).select(*found)))
    size = F.coalesce(F.col("group_size"), F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return decided.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], keep.alias("keep_id"), size.alias("group_size"),
                          F.col("id").eqNullSafe(keep).alias("kept"))


def distinct_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 32,
                   digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``: one of those with the largest id.

    Only texts that repeat with one id take the last step, which merges equal texts in each task first.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).alias("id"), digest(filled).alias("digest"))
    tied = staged(named.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest").distinct(),
                  scratch_dir(docs.sparkSession), "tied")
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept")]
    # As in exact_dedup, no column of the input can clash.
    kept = exact_dedup(docs, text, doc_id, salts, digest).where("kept").select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)],
                                                                              filled.alias("text"))
    if not tied.isEmpty():
        keyed = kept.withColumn("digest", digest(F.col("text")))
        kept = (keyed.join(tied, "digest", "left_anti").drop("digest")
                .unionByName(keyed.join(tied, "digest", "left_semi").drop("digest").dropDuplicates(["text"])))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
