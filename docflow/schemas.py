"""Fixed schemas of the normalised tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS = ("doc_id string, parent_doc_id string, content string, content_chunk_group string, "
        "metadata string, annotations string, sha256 string, size_bytes bigint")

# chunk_idx is dense (0..n-1) within (doc_id, owner, chunk_group); owner is the path of the node that has
# the group, '' for the document itself, and owner_id that node's id (see operators/tree.py).
CHUNKS = ("doc_id string, chunk_group string, chunk_idx int, chunk_id string, parent string, "
          "start int, length int, content string, metadata string, annotations string, depth int, "
          "content_chunk_group string, owner string, owner_id string")

PART = ("struct<kind:string,text:string,url:string,filename:string,tool_name:string,call_id:string,"
        "call_type:string,arguments:string,rationale:string,response:string>")
TURNS = f"conv_id string, turn int, role string, parts array<{PART}>"

ERROR = ("struct<provider:string,message:string,name:string,status:int,interpreted_type:string,"
         "interpreted_code:int,interpreted_message:string,details:string>")


def _conform(df: DataFrame, ddl: str, extra=()) -> DataFrame:
    cols = []
    for item in ddl.split(", "):
        name, typ = item.split(" ", 1)
        cols.append((F.col(name) if name in df.columns else F.lit(None)).cast(typ).alias(name))
    return df.select(*cols, *extra)


def as_docs(df: DataFrame) -> DataFrame:
    """Select, cast and null-fill to the ``docs`` schema."""
    return _conform(df, DOCS)


def as_chunks(df: DataFrame, extra=()) -> DataFrame:
    """Select, cast and null-fill to the ``chunks`` schema; ``extra`` columns are kept. Rows without an owner
    belong to their document."""
    return _conform(df, CHUNKS, extra).withColumns({"owner": F.coalesce("owner", F.lit("")), "owner_id": F.coalesce("owner_id", "doc_id")})
