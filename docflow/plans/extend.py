"""Extending a table of conversations: model replies and tool rounds."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import json_kind, member
from docflow.operators.ordering import concat_ordered
from docflow.operators.tools import ToolRegistry, execute_tool_calls
from docflow.operators.transcripts import message_json, part
from docflow.plans.structured import ask, failure
from docflow.schemas import ERROR, PART
from docflow.session import cut_lineage, work_folder

# Fixed value: rounds of tool calls after the first call.
MAX_ROUNDS = 10
CALLS = "array<struct<name:string,call_id:string,arguments:variant,rationale:string>>"


def conversation_requests(turns: DataFrame, system: str) -> DataFrame:
    """(conv_id, system, user, next_turn): ``user`` is the JSON array of all messages."""
    rows = turns.withColumn("_json", message_json(F.col("role"), F.col("parts")))
    whole = concat_ordered(rows, ["conv_id"], "turn", "_json", ",", "_m")
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"))
    return whole.join(ends, "conv_id").select("conv_id", F.lit(system).alias("system"), F.concat(F.lit("["), "_m", F.lit("]")).alias("user"), "next_turn")


def _called(reply: Column) -> Column:
    """Tool calls of a reply ``{"tool_calls": [{name, call_id, arguments, rationale}]}``."""
    calls = member(F.try_parse_json(reply), "tool_calls")
    return F.when(json_kind(calls) == "ARRAY", F.try_variant_get(calls, "$", CALLS))


def _turn(role: str, parts: Column, turn: Column) -> list[Column]:
    return ["conv_id", turn.cast("int").alias("turn"), F.lit(role).alias("role"), parts.cast(f"array<{PART}>").alias("parts")]


def extend_transcripts(turns: DataFrame, model, system: str = "", tools: ToolRegistry | None = None, max_rounds: int | None = MAX_ROUNDS,
                       schema: dict | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """(suffix turns, errors (conv_id, error)) for every conversation in ``turns``.

    Without tools one call per conversation. With tools a reply may ask for calls: server
    tools run and the conversation is asked again; a call of a client tool ends it with the
    call pending. Only unfinished conversations take part in a round. One that still asks for calls
    after ``max_rounds`` keeps its turns so far and gets an error row; None sets no end.
    """
    requests = conversation_requests(turns, system)
    if tools is None:
        asked = ask(requests, model, schema, **limits)
        suffix = asked.where("error is null").select(*_turn("assistant", F.array(part("text", text=F.col("reply"))), F.col("next_turn")))
        return suffix, asked.where("error is not null").select("conv_id", "error")

    client = [t.name for t in tools.by_kind("client")]
    is_client = (lambda n: n.isin(*client)) if client else (lambda n: F.lit(False))
    spark, folder = turns.sparkSession, work_folder(turns.sparkSession)
    base = turns.select("conv_id", "turn", "role", "parts")
    # Every round appends its new turns and errors to logs; only the ids of open conversations go on.
    log = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}").select(*schema.names)
    new_turns, error_rows = base.schema, requests.select("conv_id", F.lit(None).cast(ERROR).alias("error")).schema
    going = None
    for no in itertools.count():
        active = base if going is None else base.unionByName(log("turns", new_turns)).join(going, "conv_id", "left_semi")
        asked = cut_lineage(ask(conversation_requests(active, system), model, schema, **limits).withColumn("calls", _called(F.col("reply"))))
        errors = asked.where("error is not null").select("conv_id", "error")
        answered = asked.where("error is null")
        plain = answered.where(F.coalesce(F.size("calls") <= 0, F.lit(True)))
        replies = plain.select(*_turn("assistant", F.array(part("text", text=F.col("reply"))), F.col("next_turn")))
        calling = answered.where(F.size("calls") > 0)
        calls = calling.select("conv_id", "next_turn", F.posexplode("calls").alias("pos", "c")).select(
            "conv_id", "next_turn", "pos", F.col("c.name").alias("tool_name"),
            # Providers without call ids get one that a re-run repeats.
            F.coalesce("c.call_id", F.concat(F.lit("call-"), F.col("next_turn").cast("string"), F.lit("-"), F.col("pos").cast("string"))).alias("call_id"),
            F.to_json("c.arguments").alias("arguments"), F.col("c.rationale").alias("rationale"))
        call_part = part("tool_call", tool_name=F.col("tool_name"), call_id=F.col("call_id"), call_type=F.lit("function"),
                         arguments=F.col("arguments"), rationale=F.col("rationale"))
        result = F.coalesce("content", F.concat(F.lit("Error: "), "error"))
        # Results are texts; as transcript JSON they are quoted strings.
        quoted = F.to_json(F.array(result))
        done = execute_tool_calls(calls.where(~is_client(F.col("tool_name"))), tools).withColumn(
            "_call", call_part).withColumn("_response", part(
                "tool_response", tool_name=F.col("tool_name"), call_id=F.col("call_id"),
                response=F.substring(quoted, F.lit(2), F.length(quoted) - 2)))
        ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("pos", name))), lambda x: x[name])
        served = done.groupBy("conv_id", "next_turn").agg(ordered("_call").alias("calls"), ordered("_response").alias("responses"))
        # One row of both, exploded, so that a call runs once.
        both = served.select("conv_id", F.explode(F.array(
            F.struct(F.col("next_turn").cast("int").alias("turn"), F.lit("tool_call").alias("role"), F.col("calls").cast(f"array<{PART}>").alias("parts")),
            F.struct((F.col("next_turn") + 1).cast("int").alias("turn"), F.lit("tool_response").alias("role"),
                     F.col("responses").cast(f"array<{PART}>").alias("parts")))).alias("t")).select("conv_id", "t.*")
        pending = calls.where(is_client(F.col("tool_name"))).withColumn("_call", call_part).groupBy("conv_id", "next_turn").agg(ordered("_call").alias("calls"))
        # Client calls follow the results of the server calls in the same reply.
        served_ids = calls.where(~is_client(F.col("tool_name"))).select("conv_id").distinct().withColumn("_shift", F.lit(2))
        waiting = pending.join(served_ids, "conv_id", "left").withColumn("_at", F.col("next_turn") + F.coalesce("_shift", F.lit(0)))
        grown = replies.unionByName(both).unionByName(waiting.select(*_turn("tool_call", F.col("calls"), F.col("_at"))))
        grown.write.parquet(f"{folder}/turns/round={no}")
        going = calling.select("conv_id").join(pending.select("conv_id"), "conv_id", "left_anti")
        last = calling.isEmpty() or (max_rounds is not None and no == max_rounds)
        if last:
            # Calls of the last round have run and stay in the turns; there is only no reply to the results.
            message = f"No final reply after {max_rounds} rounds of tool calls."
            errors = errors.unionByName(going.select("conv_id", failure(message, "tool_rounds_exhausted", 500).alias("error")))
        errors.write.parquet(f"{folder}/errors/round={no}")
        if last:
            return log("turns", new_turns), log("errors", error_rows)
        going = cut_lineage(going)
