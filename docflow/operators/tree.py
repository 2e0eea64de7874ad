"""Documents inside documents as rows.

A chunk is itself a document and may have chunks. Its row names the node it belongs to: ``owner`` is that node's
path from the document (``''`` for the document itself), ``owner_id`` its id. A path is made of steps ``group@index``
joined by ``/``, so (doc_id, owner, chunk_group, chunk_idx) names a row however deep it lies, also where ids
repeat. Operators on a chunk group treat every owner's group by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ["doc_id", "owner", "chunk_group"]
CHUNK = [*GROUP, "chunk_idx"]


def owned(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``owner`` and ``owner_id``; rows without belong to their document."""
    owner = F.coalesce("owner", F.lit("")) if "owner" in chunks.columns else F.lit("")
    owner_id = F.coalesce("owner_id", "doc_id") if "owner_id" in chunks.columns else F.col("doc_id")
    return chunks.withColumns({"owner": owner, "owner_id": owner_id})


def _escaped(group: Column) -> Column:
    for c in "%/@":
        group = F.replace(group, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return group


def path_of(owner: Column, group: Column, idx: Column) -> Column:
    """Path of the chunk with index ``idx`` in a group of the node ``owner``."""
    step = F.concat(_escaped(group), F.lit("@"), idx.cast("string"))
    return F.when(owner == "", step).otherwise(F.concat(owner, F.lit("/"), step))


def level_of(owner: Column) -> Column:
    """1 for chunks of the document itself, 2 for their chunks, and so on."""
    return F.when(owner == "", 1).otherwise(F.size(F.split(owner, "/")) + 1)


def node_key(doc_id: Column, owner: Column, *more: Column) -> Column:
    """One text that names a node: the document's id, or for inner nodes a JSON array. ``node_fields`` undoes it."""
    plain = (owner == "") & ~doc_id.startswith('["')
    return F.when(plain, doc_id).otherwise(F.to_json(F.array(doc_id, owner, *more)))


def node_fields(key: Column) -> Column:
    """(doc_id, owner, owner_id) of a key made from all three."""
    inner = F.from_json(key, "array<string>")
    fields = lambda a: F.struct(F.get(a, F.lit(0)).alias("doc_id"), F.get(a, F.lit(1)).alias("owner"), F.get(a, F.lit(2)).alias("owner_id"))
    bound = F.transform(F.array(inner), fields)[0]
    return F.when(key.startswith('["'), bound).otherwise(F.struct(key.alias("doc_id"), F.lit("").alias("owner"), key.alias("owner_id")))


def nodes_as_docs(chunks: DataFrame) -> DataFrame:
    """Chunk rows whose ``doc_id`` is the key of their owner, for operators that know documents only."""
    return owned(chunks).withColumn("doc_id", node_key(F.col("doc_id"), F.col("owner"), F.col("owner_id"))).drop("owner", "owner_id")


def docs_as_nodes(rows: DataFrame) -> DataFrame:
    """Undo ``nodes_as_docs``."""
    return rows.withColumn("_node", node_fields(F.col("doc_id"))).withColumns(
        {c: F.col(f"_node.{c}") for c in ("doc_id", "owner", "owner_id")}).drop("_node")
