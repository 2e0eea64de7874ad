"""Document JSON into the normalised tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.jsonx import json_kind
from docflow.operators.tree import level_of, path_of
from docflow.schemas import as_chunks, as_docs
from docflow.session import stored

# Members of a document object; chunks stay JSON texts until their level is parsed.
OBJECT = ("struct<id:string,parent:string,start:string,length:string,content:variant,content_chunk_group:string,metadata:string,"
          "annotations:string,embeddings:map<string,array<float>>,chunks:map<string,array<string>>,continues:string>")


def parse_docs(texts: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, chunks, rejects) from document objects in JSON texts.

    Chunks of chunks get ``depth`` > 1, the path and id of the chunk they belong to as ``owner`` and
    ``owner_id``, and that id as ``parent`` if they name none, however deep they are: a level is parsed as
    long as there is one. Rows that are not JSON objects go to rejects. Parts of a document (``nest_docs``) are no
    documents; their chunks take their places in the group they continue.
    """
    text = F.col(json_col)
    ok = F.coalesce(json_kind(F.try_parse_json(json_col)) == "OBJECT", F.lit(False))
    rejects = texts.where(~ok).select(text.alias("text"), F.lit("not a JSON object").alias("reason"))
    # One parse per object; the columns are fields of its result.
    good = texts.where(ok).select(F.from_json(text, OBJECT).alias("o"))
    docs = good.where(_continued()["owner"].isNull()).select(F.col("o.id").alias("doc_id"), F.col("o.parent").alias("parent_doc_id"), _content().alias("content"),
                       "o.content_chunk_group", "o.metadata", "o.annotations")
    chunks = None
    for level in _levels(good):
        rows = level.select(
            "doc_id", "owner", "owner_id", "chunk_group", "chunk_idx", F.col("o.id").alias("chunk_id"),
            F.coalesce("o.parent", "owner_id").alias("parent"), F.col("o.start").try_cast("int").alias("start"), F.col("o.length").try_cast("int").alias("length"), F.col("o.content").alias("content"),
            "o.metadata", "o.annotations", level_of(F.col("owner")).alias("depth"), "o.content_chunk_group")
        chunks = rows if chunks is None else chunks.unionByName(rows)
    docs = docs.withColumn("sha256", F.sha2("content", 256)).withColumn("size_bytes", F.octet_length("content"))
    return as_docs(docs), as_chunks(chunks), rejects


def _content() -> Column:
    """Content only if it is a string: anything else does not count as text."""
    v = F.col("o.content")
    return F.when(json_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _continued() -> Column:
    """The node whose chunks an object continues, and the index of its first chunk; NULL fields if it is a document itself."""
    return F.from_json("o.continues", "struct<owner:string,owner_id:string,at:int>")


def _children(owners: DataFrame) -> DataFrame:
    """Chunks of ``owners(doc_id, owner, owner_id, at, o)``, their content a string; the first of each group has index ``at``."""
    items = owners.select("doc_id", "owner", "owner_id", "at", F.explode("o.chunks").alias("chunk_group", "items"))
    return items.select("doc_id", "owner", "owner_id", "chunk_group", "at", F.posexplode("items").alias("_i", "_j")).select(
        "doc_id", "owner", "owner_id", "chunk_group", (F.col("_i") + F.col("at")).alias("chunk_idx"), F.from_json("_j", OBJECT).alias("o")).withColumn(
        "o", F.col("o").withField("content", _content()))


def _levels(objects: DataFrame) -> Iterator[DataFrame]:
    """Chunks of the documents ``o``, chunks of these, and so on, as long as there are any."""
    placed = objects.withColumn("c", _continued())
    level = stored(_children(placed.select(F.col("o.id").alias("doc_id"), F.coalesce("c.owner", F.lit("")).alias("owner"),
                                           F.when(F.col("c.owner").isNull(), F.col("o.id")).otherwise(F.col("c.owner_id")).alias("owner_id"),
                                           F.when(F.col("c.owner").isNull(), 0).otherwise(F.coalesce("c.at", F.lit(0))).alias("at"), "o")))
    while True:
        yield level
        deeper = level.where(F.col("o.chunks").isNotNull())
        if deeper.isEmpty():
            return
        level = stored(_children(deeper.select("doc_id", path_of(F.col("owner"), F.col("chunk_group"), F.col("chunk_idx")).alias("owner"),
                                               F.col("o.id").alias("owner_id"), F.lit(0).alias("at"), "o")))


def parse_embeddings(texts: DataFrame, json_col: str = "json") -> DataFrame:
    """(doc_id, owner, chunk_group, chunk_idx, chunk_id, model, vector) of chunks at all levels."""
    rows = [level.select("doc_id", "owner", "chunk_group", "chunk_idx", F.col("o.id").alias("chunk_id"), F.explode("o.embeddings").alias("model", "vector"))
            for level in _levels(texts.select(F.from_json(json_col, OBJECT).alias("o")))]
    return reduce(DataFrame.unionByName, rows)


def read_docs(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents from JSON-lines files, or one document per file with ``whole_files``."""
    texts = spark.read.text(path, wholetext=whole_files).withColumnRenamed("value", "json")
    return parse_docs(texts.where(F.trim("json") != ""))
