"""Chat transcripts as rows: parts, parsing, joining, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import json_kind, json_object, member
from docflow.functions.text import json_string
from docflow.operators.ordering import concat_ordered
from docflow.schemas import PART

FIELDS = ("kind", "text", "url", "filename", "tool_name", "call_id", "call_type", "arguments", "rationale", "response")


def part(kind: str, **fields: Column) -> Column:
    """A message part; ``arguments`` and ``response`` are JSON texts."""
    return F.struct(F.lit(kind).alias("kind"), *[
        (fields[n] if n in fields else F.lit(None)).cast("string").alias(n) for n in FIELDS[1:]])


def text_turns(df: DataFrame, text: str = "text") -> DataFrame:
    """Turns from (conv_id, turn, role, text)."""
    return df.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role",
                     F.array(part("text", text=F.col(text))).alias("parts"))


def message_text(parts: Column) -> Column:
    """Texts of a message's text parts, one per line."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["text"]), "\n")


def read_transcripts(df: DataFrame, transcript: str = "transcript") -> DataFrame:
    """Turns from transcript JSON ``{"messages": [{"role", "content"}]}`` per ``conv_id``."""
    schema = "struct<messages:array<struct<role:string,content:variant>>>"
    rows = df.select("conv_id", F.posexplode(F.from_json(transcript, schema)["messages"]).alias("turn", "m"))
    role, content = F.col("m.role"), F.col("m.content")
    text = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    as_json = lambda v, name: F.to_json(member(v, name))

    def item(v: Column) -> Column:
        kind = text(v, "type")
        tool = text(v, "toolName")
        return (F.when(json_kind(v) == "STRING", part("text", text=F.try_variant_get(v, "$", "string")))
                .when(kind == "image", part("image", url=text(v, "url")))
                .when(kind == "document", part("document", filename=text(v, "filename"), text=text(v, "content")))
                .when((role == "tool_call") & tool.isNotNull(), part(
                    "tool_call", tool_name=tool, call_id=text(v, "callId"), call_type=text(v, "callType"),
                    arguments=as_json(v, "arguments"), rationale=F.nullif(text(v, "rationale"), F.lit(""))))
                .when((role == "tool_response") & tool.isNotNull(), part(
                    "tool_response", tool_name=tool, call_id=text(v, "callId"), response=as_json(v, "response")))
                .otherwise(part("json", text=F.to_json(v))))

    parts = F.when(json_kind(content) == "STRING", F.array(part("text", text=F.try_variant_get(content, "$", "string")))).when(
        json_kind(content) == "ARRAY", F.transform(F.try_variant_get(content, "$", "array<variant>"), item)).when(
        content.isNotNull(), F.array(part("json", text=F.to_json(content)))).otherwise(F.array().cast(f"array<{PART}>"))
    return rows.select("conv_id", "turn", role.alias("role"), parts.cast(f"array<{PART}>").alias("parts"))


def part_json(p: Column) -> Column:
    """A part in transcript JSON."""
    s = lambda name: F.coalesce(json_string(p[name]), F.lit("null"))
    raw = lambda name: F.coalesce(p[name], F.lit("null"))
    return (F.when(p["kind"] == "text", s("text")).when(p["kind"] == "json", p["text"])
            .when(p["kind"] == "image", json_object(("type", F.lit('"image"')), ("url", s("url"))))
            .when(p["kind"] == "document", json_object(("type", F.lit('"document"')), ("filename", s("filename")), ("content", s("text"))))
            .when(p["kind"] == "tool_call", json_object(
                ("toolName", s("tool_name")), ("callId", s("call_id")), ("callType", json_string(p["call_type"])),
                ("arguments", raw("arguments")), ("rationale", s("rationale"))))
            .otherwise(json_object(("toolName", s("tool_name")), ("callId", s("call_id")), ("response", raw("response")))))


def message_json(role: Column, parts: Column) -> Column:
    """A message in transcript JSON; a single text is a plain string."""
    plain = (F.size(parts) == 1) & (parts[0]["kind"] == "text")
    content = F.when(plain, json_string(parts[0]["text"])).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform(parts, part_json), ","), F.lit("]")))
    return json_object(("role", json_string(role)), ("content", content))


def transcripts_json(turns: DataFrame) -> DataFrame:
    """(conv_id, json, reason) with the messages of each conversation in order. A conversation too long for
    one cell has no JSON but reason ``transcript_too_large``."""
    rows = turns.withColumn("_json", message_json(F.col("role"), F.col("parts")))
    whole = concat_ordered(rows, ["conv_id"], "turn", "_json", ",", "_m")
    return whole.select("conv_id", F.concat(F.lit('{"messages":['), "_m", F.lit("]}")).alias("json"),
                        F.when(F.col("_m").isNull(), F.lit("transcript_too_large")).alias("reason"))


def concat_transcripts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append the turns of ``b`` behind those of ``a``, per conversation."""
    ends = a.groupBy("conv_id").agg((F.max("turn") + 1).alias("_n"))
    moved = b.join(ends, "conv_id", "left").withColumn("turn", (F.col("turn") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    return a.unionByName(moved)


def attach_parts(turns: DataFrame, attachments: DataFrame) -> DataFrame:
    """Append ``attachments(conv_id, turn, idx, part)`` to the parts of their messages."""
    by_turn = attachments.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "part"))),
                                                                     lambda x: x["part"]).alias("_more"))
    joined = turns.join(by_turn, ["conv_id", "turn"], "left")
    more = F.coalesce("_more", F.array()).cast(f"array<{PART}>")
    return joined.withColumn("parts", F.concat(F.col("parts").cast(f"array<{PART}>"), more)).select(*turns.columns)


def _tool_parts(turns: DataFrame, role: str) -> DataFrame:
    rows = turns.where(F.col("role") == role).select("conv_id", "turn", F.explode("parts").alias("p"))
    return rows.where(F.col("p.kind") == role).select("conv_id", "turn", "p.tool_name", "p.call_id", "p.arguments", "p.response")


def tool_calls(turns: DataFrame) -> DataFrame:
    return _tool_parts(turns, "tool_call").drop("response")


def match_tool_results(turns: DataFrame) -> DataFrame:
    """Calls with their results by call id; unmatched ones on either side are kept."""
    calls = tool_calls(turns).withColumnRenamed("turn", "call_turn")
    results = _tool_parts(turns, "tool_response").select("conv_id", F.col("turn").alias("response_turn"), F.col("tool_name").alias("_tool"), "call_id", "response")
    both = calls.join(results, ["conv_id", "call_id"], "full_outer")
    return both.withColumn("tool_name", F.coalesce("tool_name", "_tool")).drop("_tool")


def pending_tool_calls(turns: DataFrame) -> DataFrame:
    """Calls that have no result yet."""
    done = _tool_parts(turns, "tool_response").select("conv_id", "call_id")
    return tool_calls(turns).join(done, ["conv_id", "call_id"], "left_anti")
