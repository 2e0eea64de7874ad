"""Document outputs: chunk listings, nested document JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.jsonx import annotation, json_object
from docflow.functions.text import json_string
from docflow.operators.ordering import TEXT_BLOCK, TEXT_CELL_LIMIT, block_no, block_prefix, concat_ordered
from docflow.operators.tree import CHUNK, GROUP, level_of, owned, path_of
from docflow.session import cut_lineage, kept, small, stored

PART = 1 << 20      # characters of the chunks in one part of an object

def file_title(metadata: Column) -> Column:
    def name(key: str) -> Column:
        v = annotation(metadata, key)
        return F.when(v != "", v)
    return F.coalesce(name("originating_filename"), name("filename"), F.lit("Document"))


def chunk_listing(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index from 1, title, body, chunk_data) of the chunks of one group."""
    named = chunks.join(docs.select("doc_id", file_title(F.col("metadata")).alias("_name")), "doc_id")
    index = F.col("chunk_idx") + 1
    title = F.concat("_name", F.lit(" (Part "), index.cast("string"), F.lit(")"))
    return named.select("doc_id", index.alias("chunk_index"), title.alias("title"),
                        F.col("content").alias("body"),
                        F.to_json(F.struct(title.alias("title"), F.col("content").alias("body"))).alias("chunk_data"))


def nest_docs(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame | None = None,
              limit: int = TEXT_CELL_LIMIT, part: int | None = None) -> DataFrame:
    """(doc_id, json, reason): one document object per row, chunk groups nested in order at every level.

    Levels are nested from the deepest up; text is concatenated block by block. A document too long for one
    cell has no JSON but reason ``document_too_large``; ``write_docs`` stores its rows instead.

    With ``part`` objects have any length: where the chunks of a document or chunk have more than ``part`` characters, its
    object comes without them, and they follow in rows of at most about ``part`` characters, each an object with the
    document's ``id``, some ``chunks`` of one group and ``continues``: path (``owner``) and id (``owner_id``) of the node
    they belong to, and the index (``at``) of the first of them. ``parse_docs`` reads both. A level's texts then move in
    one shuffle, and its files are deleted when the level above is written.
    """
    rows = owned(chunks).withColumn("_level", level_of(F.col("owner")))
    vectors = F.lit(None).cast("string")
    if embeddings is not None:
        by_chunk = owned(embeddings).groupBy(*CHUNK).agg(
            F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "vector"))))).alias("_vec"))
        rows = rows.join(by_chunk, CHUNK, "left")
        vectors = F.col("_vec")
    number = lambda c: F.col(c).cast("string")
    fields = (("id", json_string(F.col("chunk_id"))), ("parent", json_string(F.col("parent"))),
              ("start", number("start")), ("length", number("length")),
              ("content", json_string(F.col("content"))), ("metadata", F.col("metadata")),
              ("annotations", F.col("annotations")), ("embeddings", vectors),
              ("content_chunk_group", json_string(F.col("content_chunk_group"))))
    inner = ("chunks", F.concat(F.lit("{"), F.col("_groups"), F.lit("}")))
    groups, parts, above, last = None, [], None, None
    if part is not None:
        # Objects without the chunks of their own; these are put in behind.
        above = kept(lambda: [rows.select(*CHUNK, "owner_id", "_level", json_object(*fields).alias("_own")).withColumn("_n", F.length("_own"))])
        rows = above[0]
    deepest = rows.agg(F.max("_level")).first()[0] or 1
    for level in range(deepest, 0, -1):
        own = rows.where(F.col("_level") == level)
        if groups is not None:
            own = own.withColumn("_path", path_of(F.col("owner"), F.col("chunk_group"), F.col("chunk_idx"))).join(groups, ["doc_id", "_path"], "left")
        large = F.coalesce("_large", F.lit(False)) if groups is not None else F.lit(False)
        if part is None:
            own = own.withColumns({"_json": json_object(*fields, *([inner] if groups is not None else [])), "_large": large})
            groups = _grouped(own, _sizes(own.withColumn("_n", F.length("_json"))).where((F.col("_n") > limit) | F.col("_large")))
            if level > 1:
                groups = cut_lineage(groups)
            continue
        if groups is None:
            own = own.withColumnRenamed("_own", "_json")
        else:
            bare = F.substring(F.col("_own"), F.lit(1), F.col("_n") - 1)
            filled = F.concat(bare, F.when(F.col("_n") > 2, ",").otherwise(""), F.lit('"chunks":'), inner[1], F.lit("}"))
            own = own.withColumn("_json", F.when(F.col("_groups").isNull(), F.col("_own")).otherwise(filled)).withColumn("_n", F.length("_json"))
        own = own.select(*CHUNK, "owner_id", "_json", large.alias("_large"), "_n")
        if level < deepest:
            here = kept(lambda: [own])
            for done in (last, above if level == 1 else None):
                if done is not None:
                    done.drop()
            last, own = here, here[0]
        long = F.col("_n") > part
        apart = stored(_sizes(own).where(long | (F.col("_n") > limit) | F.col("_large")).select("doc_id", "owner", long.alias("_long")))
        n_long, n_apart = apart.where("_long").count(), apart.count()
        # An owner fits into one task here. Rows of the document itself meet by its id alone, as they meet it below.
        fitting = own.join(small(apart, n_apart), ["doc_id", "owner"], "left_anti") if n_apart else own
        groups = _grouped(fitting.repartition("doc_id", *(["owner"] if level > 1 else [])), apart.where("NOT _long") if n_apart > n_long else None)
        if n_long:
            owners = stored(apart.where("_long").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "owner"))
            rows_apart = _parts(own.join(small(owners, n_long), ["doc_id", "owner"], "left_semi"), part)
            parts.append(stored(rows_apart) if level > 1 else rows_apart)
    full = docs.join(groups.where("_path = ''"), "doc_id", "left")
    whole = ~F.coalesce("_large", F.lit(False))
    text = json_object(
        ("id", json_string(F.col("doc_id"))), ("parent", json_string(F.col("parent_doc_id"))),
        ("content", json_string(F.col("content"))),
        ("content_chunk_group", json_string(F.col("content_chunk_group"))),
        ("metadata", F.col("metadata")), ("annotations", F.col("annotations")), inner)
    out = full.select("doc_id", F.when(whole, text).alias("json"), F.when(~whole, F.lit("document_too_large")).alias("reason"))
    for rows_apart in parts:
        out = out.unionByName(rows_apart)
    return out


def _parts(rows: DataFrame, part: int) -> DataFrame:
    """(doc_id, json, reason): the chunks ``rows(*CHUNK, owner_id, _json, _n)`` as objects of at most about ``part`` characters.

    Texts are shuffled once, by block of the index, and every block is cut for itself; where a block begins is
    counted without the texts."""
    block = [*GROUP, "_blk"]
    blocked = rows.withColumn("_blk", block_no("chunk_idx", TEXT_BLOCK))
    begin = stored(block_prefix(blocked.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows")), GROUP, {"_begin": "_rows"}))
    w = Window.partitionBy(*block).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.repartition(*block).select("*", F.coalesce(F.sum(F.col("_n") + 1).over(w), F.lit(0)).alias("_before"), F.count(F.lit(1)).over(w).alias("_in"))
    runs = placed.groupBy(*block, F.floor(F.col("_before") / part).alias("_run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_in", "_json"))), lambda x: x["_json"]), ",").alias("_arr"),
        F.min("_in").alias("_in"), F.max("owner_id").alias("owner_id")).join(begin, block, "left")
    at = F.coalesce("_begin", F.lit(0)) + F.col("_in")
    continues = json_object(("owner", json_string(F.col("owner"))), ("owner_id", json_string(F.col("owner_id"))), ("at", at.cast("string")))
    chunks = F.concat(F.lit("{"), json_string(F.col("chunk_group")), F.lit(":["), F.col("_arr"), F.lit("]}"))
    text = json_object(("id", json_string(F.col("doc_id"))), ("continues", continues), ("chunks", chunks))
    return runs.select("doc_id", text.alias("json"), F.lit(None).cast("string").alias("reason"))


def _sizes(rows: DataFrame) -> DataFrame:
    """Characters of the objects, ``_n`` each, of every owner, and whether one of them is too large for a cell."""
    return rows.groupBy("doc_id", "owner").agg(F.sum(F.col("_n") + 1).alias("_n"), F.max("_large").alias("_large"))


def _grouped(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    """(doc_id, _path, _groups, _large) of the owners of ``rows``: their groups as members of a JSON object.

    Sizes are summed apart from the texts; the texts of the owners ``large``, too large for a cell, are not moved.
    """
    fitting = rows if large is None else rows.join(large.select("doc_id", "owner"), ["doc_id", "owner"], "left_anti")
    arrays = concat_ordered(fitting, GROUP, "chunk_idx", "_json", ",", "_arr", None)
    member = lambda g: F.concat(json_string(g["chunk_group"]), F.lit(":["), g["_arr"], F.lit("]"))
    groups = arrays.groupBy("doc_id", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_group", "_arr"))), member), ",").alias("_groups"))
    groups = groups.withColumn("_large", F.lit(False))
    if large is not None:
        groups = groups.unionByName(large.select("doc_id", "owner", F.lit(None).cast("string").alias("_groups"), F.lit(True).alias("_large")))
    return groups.withColumnRenamed("owner", "_path")


def write_docs(docs: DataFrame, chunks: DataFrame, path: str, mode: str = "errorifexists",
               embeddings: DataFrame | None = None) -> None:
    """One document object per line. Chunk rows of documents too long for a line go to
    ``<path>.parts`` as a table, so nothing is lost."""
    nested = nest_docs(docs, chunks, embeddings)
    nested.where(F.col("json").isNotNull()).select(F.col("json").alias("value")).write.mode(mode).text(path)
    large = nested.where(F.col("json").isNull()).select("doc_id")
    if not large.isEmpty():
        chunks.join(large, "doc_id", "left_semi").write.mode(mode).parquet(f"{path}.parts")
