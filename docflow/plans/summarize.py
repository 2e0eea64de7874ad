"""Summarisation: full, map, map with a token budget, fold, delta-fold, merge, map-merge.

Full, map and the merge tree ask all documents and chunks in parallel. Fold, delta-fold,
budgeted map and left-to-right merge are serial inside a document by definition - each
prompt contains the reply before it - and parallel across documents:

* a ColumnModel runs as an ``aggregate()`` over segments of at most ``SEGMENT`` chunks,
  carrying the state from segment to segment, so no task holds a whole long document;
* a BatchModel runs in rounds, one chunk position of every document per round, each round
  written to the checkpoint folder so that no call is repeated when an executor is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import json_kind, parse_reply
from docflow.functions.text import json_string, token_count, trim_all
from docflow.plans.models import BatchModel, ColumnModel
from docflow.plans.prompts import (as_json, chunk_prompt, context_parts, delta_prompt, fold_prompt, full_prompt,
                                   merge_prompt, system_prompt, with_context, word_constraint)
from docflow.functions.schema_check import violations
from docflow.plans.structured import INVALID, ask, failure
from docflow.schemas import ERROR
from docflow.session import cut_lineage, work_folder

SEGMENT = 256
TREE_LEVELS = 8           # tree levels folded per shuffle with a ColumnModel
METHODS = ("full", "map", "fold", "delta-fold", "merge", "map-merge")


def _settled(reply: Column, schema: dict | None) -> Column:
    """What a reply is stored as: text, or compact JSON if a schema asks for JSON."""
    return reply if schema is None else parse_reply(reply)


# --- parallel methods -------------------------------------------------------------------

def summarize_full(docs: DataFrame, model, guidance: str = "", schema: dict | None = None, **limits) -> DataFrame:
    """(doc_id, summary, error): one call per document with resolved content."""
    requests = docs.select("doc_id", F.lit(system_prompt("full", guidance, schema)).alias("system"), full_prompt().alias("user"))
    return ask(requests, model, schema, **limits).select("doc_id", _settled(F.col("reply"), schema).alias("summary"), "error")


def summarize_map(chunks: DataFrame, model, group: str, guidance: str = "", schema: dict | None = None,
                  before: int = 0, after: int = 0, wrap: bool = True, **limits) -> DataFrame:
    """(doc_id, chunk_idx, chunk_id, summary, error): one call per chunk."""
    rows = with_context(chunks.where(F.col("chunk_group") == group), before, after, wrap)
    requests = rows.select("doc_id", "chunk_idx", "chunk_id", F.lit(system_prompt("map", guidance, schema)).alias("system"),
                           chunk_prompt(wrap).alias("user"))
    return ask(requests, model, schema, **limits).select(
        "doc_id", "chunk_idx", "chunk_id", _settled(F.col("reply"), schema).alias("summary"), "error")


# --- serial machinery ---------------------------------------------------------------------

def _serial(rows: DataFrame, item: list[str], state: dict[str, Column], step: Callable[[Column, Column], Column],
            out: Callable[[Column], Column] | None, out_type: str | None, seed: DataFrame | None = None,
            segment: int = SEGMENT) -> tuple[DataFrame, DataFrame | None]:
    """Fold ``step`` over the chunks of each document with a ColumnModel.

    ``state`` maps state columns to initial values (over ``seed`` columns if given);
    ``step(state, item)`` gives the next state, ``out`` a row per chunk to keep from the
    state after it. Returns (final state per document, kept rows per chunk).
    """
    last = rows.agg(F.max("chunk_idx")).first()[0]
    rounds = 0 if last is None else last // segment + 1
    names = list(state)
    rows = rows.withColumn("_seg", F.floor(F.col("chunk_idx") / segment).cast("int"))
    if rounds > 1:
        store = SegmentStore(rows, "_seg", rows.where("_seg > 0"), "_seg")
    current = None
    for r in range(max(rounds, 1)):
        part = rows if rounds <= 1 else rows.where("_seg = 0") if r == 0 else store.segment(r)
        items = part.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", *item))).alias("items"))
        if current is None:
            opened = items.join(seed, "doc_id", "left") if seed is not None else items
        else:
            # Documents whose first segments are missing open here.
            before = current.select("doc_id", F.lit(True).alias("_on"), *[F.col(n).alias(f"_o_{n}") for n in names])
            opened = (items.join(seed, "doc_id", "left") if seed is not None else items).join(before, "doc_id", "left")
        carried = (lambda n, c: c) if current is None else (lambda n, c: F.when(F.col("_on"), F.col(f"_o_{n}")).otherwise(c))
        opened = opened.select("doc_id", "items", *[carried(n, c).alias(f"_s_{n}") for n, c in state.items()])
        fields = [F.col(f"_s_{n}").alias(n) for n in names]
        if out is None:
            start, fold = F.struct(*fields), step
        else:
            empty = F.array().cast(f"array<{out_type}>")
            start = F.struct(*fields, empty.alias("rows"))

            def fold(s, x):
                nxt = step(s, x)
                # The one-element array binds the next state once.
                return F.transform(F.array(nxt), lambda b: F.struct(
                    *[b[n].alias(n) for n in names],
                    F.concat(s["rows"], F.array(out(b, s, x))).alias("rows")))[0]
        done = opened.select("doc_id", F.aggregate("items", start, fold).alias("s"))
        flat = done.select("doc_id", *[F.col(f"s.{n}").alias(n) for n in names], *([F.col("s.rows").alias("rows")] if out is not None else []))
        if rounds > 1:
            current = store.advance(flat, r, names)
    if rounds > 1:
        flat = store.log()
    # Of several rounds a document's state is that of its last one.
    after = flat.where("_end = _round") if rounds > 1 else flat
    kept = flat.select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.*") if out is not None else None
    return after.select("doc_id", *names), kept


class SegmentStore:
    """Rows and states of a serial run as files: the rows dealt to a folder for each segment, which its round reads and no
    other, and a log to which every round appends its states once. Nothing is rewritten."""

    def __init__(self, rows: DataFrame, position: str, stored: DataFrame, number: str, order: str | None = None):
        """``rows`` with their round in ``position``; those of ``stored`` are dealt by ``number`` and sorted by ``order``."""
        self.spark, self.folder, self.number = rows.sparkSession, work_folder(rows.sparkSession), number
        # Rebalancing splits large segments over files and gathers small ones.
        dealt = stored.hint("rebalance", F.col(number))
        (dealt.sortWithinPartitions(number, order) if order else dealt).write.partitionBy(number).parquet(f"{self.folder}/rows")
        # The partition column is the last of the files' columns.
        self.rows = self.spark.read.schema(stored.select(*[c for c in stored.columns if c != number], number).schema).parquet(f"{self.folder}/rows")
        ends = rows.groupBy("doc_id").agg(F.max(position).cast("int").alias("_end"), F.count_distinct(position).alias("_n"))
        self.ends = cut_lineage(ends.select("doc_id", "_end", (F.col("_n") <= F.col("_end")).alias("_gaps")))
        self.gaps = not self.ends.where("_gaps").isEmpty()
        self.waiting: DataFrame | None = None

    def segment(self, no: int) -> DataFrame:
        return self.rows.where(F.col(self.number) == no)

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/log")

    def advance(self, states: DataFrame, no: int, names: list[str]) -> DataFrame:
        """Append the states after round ``no``; those that later rounds go on from."""
        placed = states.join(self.ends.select("doc_id", "_end"), "doc_id")
        placed.write.parquet(f"{self.folder}/log/_round={no}")
        self.schema = placed.withColumn("_round", F.lit(0)).schema
        written = self.spark.read.schema(placed.schema).parquet(f"{self.folder}/log/_round={no}")
        going = written.where(F.col("_end") > no).select("doc_id", *names)
        if self.gaps:       # documents without a row in this round keep the state they had
            if self.waiting is not None:
                going = going.unionByName(self.waiting.join(written.select("doc_id"), "doc_id", "left_anti"))
            going = self.waiting = cut_lineage(going)
        return going


def _rounds(rows: DataFrame, state: DataFrame, advance: Callable[[DataFrame], DataFrame], keep: list[str],
            segment: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """Advance every document by one chunk per round with a BatchModel.

    ``advance(rows of one position joined to the state)`` returns them with the new state
    columns; ``keep`` names the per-chunk columns to collect.
    """
    last = rows.agg(F.max("chunk_idx")).first()[0]
    if last is None:
        return state, None
    names = [c for c in state.columns if c != "doc_id"]
    places = rows.withColumn("_seg", F.floor(F.col("chunk_idx") / segment).cast("int"))
    # Files are sorted by position, so a round skips the pages of the others in its segment.
    store = SegmentStore(rows, "chunk_idx", places, "_seg", "chunk_idx")
    working = store.waiting = cut_lineage(state)
    for i in range(last + 1):
        here = store.segment(i // segment).where(F.col("chunk_idx") == i).drop("_seg")
        moved = advance(here.join(working, "doc_id"))
        working = store.advance(moved.select("doc_id", "chunk_idx", *names, *[k for k in keep if k not in names]), i, names)
    log = store.log()
    return log.where("_end = _round").select(*state.columns), log.select("doc_id", "chunk_idx", *keep) if keep else None


def _prepared(chunks: DataFrame, group: str, before: int, after: int) -> DataFrame:
    rows = with_context(chunks.where(F.col("chunk_group") == group), before, after)
    head, body = context_parts()
    return rows.select("doc_id", "chunk_idx", "chunk_id", "content", head.alias("head"), body.alias("body"))


# --- fold ------------------------------------------------------------------------------------

def summarize_fold(chunks: DataFrame, model, group: str, guidance: str = "", schema: dict | None = None,
                   before: int = 0, after: int = 0, initial_summary: str = "", segment: int = SEGMENT, **limits) -> DataFrame:
    """(doc_id, summary, error): the accumulated summary after the last chunk, and the first error."""
    system = F.lit(system_prompt("fold", guidance, schema))
    rows = _prepared(chunks, group, before, after)
    is_json = schema is not None
    prompt = lambda head, body, acc: fold_prompt(head, body, as_json(acc, is_json))
    if isinstance(model, ColumnModel):
        step = lambda s, x: F.struct(_settled(model.reply(system, prompt(x["head"], x["body"], s["acc"])), schema).alias("acc"))
        state, _ = _serial(rows, ["head", "body"], {"acc": F.lit(initial_summary)}, step, None, None, segment=segment)
        return state.select("doc_id", F.col("acc").alias("summary"), _schema_error(F.col("acc"), schema).alias("error"))

    def advance(part):
        asked = part.withColumn("system", system).withColumn("user", prompt(F.col("head"), F.col("body"), F.col("acc")))
        replied = ask(asked, model, schema, **limits)
        failed = F.coalesce("failed", F.col("error"))
        return replied.withColumn("acc", F.when(F.col("error").isNull(), _settled(F.col("reply"), schema)).otherwise(F.col("acc"))).withColumn("failed", failed)

    seed = rows.groupBy("doc_id").agg(F.lit(initial_summary).alias("acc")).withColumn("failed", _no_error())
    state, _ = _rounds(rows, seed, advance, [])
    return state.select("doc_id", F.col("acc").alias("summary"), F.col("failed").alias("error"))


def _no_error() -> Column:
    return F.lit(None).cast(ERROR)


def _schema_error(value: Column, schema: dict | None) -> Column:
    """Error of a stored result that breaks the schema; the replies of a ColumnModel are checked here."""
    if schema is None:
        return _no_error()
    return F.when(F.coalesce(F.size(violations(value, schema)) > 0, F.lit(True)), failure(INVALID, "schema_validation_failed", 422)).otherwise(_no_error())


# --- delta-fold --------------------------------------------------------------------------------

def _append(inner: Column, delta: Column, json_sum: str, is_json: bool) -> Column:
    """Inner text of a JSON array after a delta: arrays are spliced with ``append``."""
    piece = as_json(delta, is_json)
    if is_json and json_sum == "append":
        piece = F.when(json_kind(F.try_parse_json(piece)) == "ARRAY",
                       F.substring(piece, F.lit(2), F.length(piece) - 2)).otherwise(piece)
    return F.when(inner == "", piece).when(piece == "", inner).otherwise(F.concat(inner, F.lit(","), piece))


def summarize_delta_fold(chunks: DataFrame, model, group: str, guidance: str = "", schema: dict | None = None,
                         before: int = 0, after: int = 0, json_sum: str = "append", initial: DataFrame | None = None,
                         segment: int = SEGMENT, **limits) -> tuple[DataFrame, DataFrame]:
    """((doc_id, summary JSON array), (doc_id, chunk_idx, delta, error)).

    ``initial(doc_id, deltas)`` seeds the array with the JSON array of an earlier run.
    """
    system = F.lit(system_prompt("delta-fold", guidance, schema))
    rows = _prepared(chunks, group, before, after)
    is_json = schema is not None
    prompt = lambda head, body, inner: delta_prompt(head, body, F.concat(F.lit("["), inner, F.lit("]")))
    seeds = None
    if initial is not None:
        seeds = initial.select("doc_id", F.substring("deltas", F.lit(2), F.length("deltas") - 2).alias("_seed"))
    first = F.coalesce("_seed", F.lit("")) if seeds is not None else F.lit("")
    if isinstance(model, ColumnModel):
        def step(s, x):
            reply = _settled(model.reply(system, prompt(x["head"], x["body"], s["inner"])), schema)
            return F.transform(F.array(reply), lambda d: F.struct(
                _append(s["inner"], d, json_sum, is_json).alias("inner"), d.alias("delta")))[0]
        out = lambda b, _s, x: F.struct(x["chunk_idx"].alias("chunk_idx"), b["delta"].alias("delta"))
        state, deltas = _serial(rows, ["head", "body"], {"inner": first, "delta": F.lit(None).cast("string")}, step, out,
                                "struct<chunk_idx:int,delta:string>", seeds, segment)
        if deltas is not None:
            deltas = deltas.withColumn("error", _schema_error(F.col("delta"), schema))
    else:
        def advance(part):
            asked = part.withColumn("system", system).withColumn("user", prompt(F.col("head"), F.col("body"), F.col("inner")))
            replied = ask(asked, model, schema, **limits).withColumn("delta", _settled(F.col("reply"), schema))
            return replied.withColumn("inner", F.when(F.col("error").isNull(), _append(F.col("inner"), F.col("delta"), json_sum, is_json)).otherwise(F.col("inner")))
        base = rows.select("doc_id").distinct()
        base = base.join(seeds, "doc_id", "left") if seeds is not None else base
        state, deltas = _rounds(rows, base.select("doc_id", first.alias("inner")), advance, ["delta", "error"])
    return state.select("doc_id", F.concat(F.lit("["), "inner", F.lit("]")).alias("summary")), deltas


# --- map with a token budget ---------------------------------------------------------------------

_STATS = ("struct<chunk_idx:int,summary:string,tokens_target:bigint,words_target:double,tokens_actual:bigint,"
          "words_per_token:double,budget_remaining:bigint,chunks_remaining:bigint,tokens_input:bigint>")


def summarize_map_budget(chunks: DataFrame, model, group: str, tokens_budget: int, guidance: str = "",
                         schema: dict | None = None, before: int = 0, after: int = 0, encoding: str = "words",
                         segment: int = SEGMENT, **limits) -> DataFrame:
    """Per chunk its summary and the budget at its turn.

    Each chunk's target is an equal share of what is left; its word limit follows the
    words-per-token ratio seen so far (start 0.75, smoothed by one).
    """
    system = F.lit(system_prompt("map", guidance, schema))
    rows = _prepared(chunks, group, before, after).withColumn("tokens_input", token_count(F.col("content"), encoding).cast("long"))
    totals = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))

    def targets(remaining, left, words, tokens_seen):
        target = F.greatest(F.floor(remaining / left), F.lit(0)).cast("long")
        ratio = words / tokens_seen
        return target, ratio, ratio * target

    user = lambda words, head, body: F.concat(word_constraint(words), F.lit("\n\n"), head, body)
    size = lambda reply: F.coalesce(token_count(trim_all(reply), encoding), F.lit(0)).cast("long")
    start = {"remaining": F.lit(tokens_budget).cast("long"), "left": F.col("_n"), "words": F.lit(0.75), "seen": F.lit(1.0),
             "reply": F.lit(None).cast("string"), "actual": F.lit(0).cast("long")}
    if isinstance(model, ColumnModel):
        def step(s, x):
            target, _ratio, words = targets(s["remaining"], s["left"], s["words"], s["seen"])
            reply = _settled(model.reply(system, user(words, x["head"], x["body"]), target), schema)
            return F.transform(F.transform(F.array(reply), lambda r: F.struct(r.alias("r"), size(r).alias("k"))), lambda b: F.struct(
                F.greatest(s["remaining"] - b["k"], F.lit(0)).cast("long").alias("remaining"), (s["left"] - 1).alias("left"),
                (s["words"] + words).alias("words"), (s["seen"] + b["k"]).alias("seen"), b["r"].alias("reply"), b["k"].alias("actual")))[0]

        def out(b, s, x):
            target, ratio, words = targets(s["remaining"], s["left"], s["words"], s["seen"])
            return F.struct(x["chunk_idx"].alias("chunk_idx"), b["reply"].alias("summary"), target.alias("tokens_target"), words.alias("words_target"),
                            b["actual"].alias("tokens_actual"), ratio.alias("words_per_token"), s["remaining"].alias("budget_remaining"),
                            s["left"].alias("chunks_remaining"), x["tokens_input"].alias("tokens_input"))
        _, stats = _serial(rows, ["head", "body", "tokens_input"], start, step, out, _STATS, totals, segment)
        return stats.withColumn("error", _schema_error(F.col("summary"), schema))

    def advance(part):
        target, ratio, words = targets(F.col("remaining"), F.col("left"), F.col("words"), F.col("seen"))
        asked = (part.withColumn("max_output_tokens", target).withColumn("words_target", words).withColumn("words_per_token", ratio)
                 .withColumn("budget_remaining", F.col("remaining")).withColumn("chunks_remaining", F.col("left"))
                 .withColumn("system", system).withColumn("user", user(F.col("words_target"), F.col("head"), F.col("body"))))
        replied = ask(asked, model, schema, **limits).withColumn("summary", _settled(F.col("reply"), schema))
        spent = replied.withColumn("tokens_actual", size(F.col("summary"))).withColumn("tokens_target", F.col("max_output_tokens"))
        return (spent.withColumn("remaining", F.greatest(F.col("remaining") - F.col("tokens_actual"), F.lit(0)).cast("long"))
                .withColumn("left", F.col("left") - 1).withColumn("words", F.col("words") + F.col("words_target"))
                .withColumn("seen", F.col("seen") + F.col("tokens_actual")))

    seed = totals.select("doc_id", *[start[n].alias(n) for n in ("remaining", "left", "words", "seen")])
    _, stats = _rounds(rows, seed, advance, ["summary", "tokens_target", "words_target", "tokens_actual", "words_per_token",
                                             "budget_remaining", "chunks_remaining", "tokens_input", "error"])
    return stats


def budget_stats(stats: DataFrame) -> DataFrame:
    """Tokens asked for and spent per document."""
    return stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_target").alias("tokens_target"),
        F.sum("tokens_actual").alias("tokens_actual"), F.min("budget_remaining").alias("least_budget"))


# --- merge -------------------------------------------------------------------------------------------

def merge_left_to_right(parts: DataFrame, model, guidance: str = "", schema: dict | None = None,
                        segment: int = SEGMENT, **limits) -> DataFrame:
    """(doc_id, summary, error, unmerged) from ``parts(doc_id, chunk_idx, summary)`` merged in order.

    A document of which a call failed, or of which a part is missing, has no summary but the error and,
    in order, the texts that were not merged: nothing already paid for is lost.
    """
    system = F.lit(system_prompt("merge", guidance, schema))
    is_json = schema is not None
    rows = parts.select("doc_id", "chunk_idx", F.coalesce("summary", F.lit("")).alias("part"))
    prompt = lambda a, b: merge_prompt(as_json(a, is_json), as_json(b, is_json), guidance)
    if isinstance(model, ColumnModel):
        step = lambda s, x: F.struct(F.when(s["acc"].isNull(), x["part"]).otherwise(
            _settled(model.reply(system, prompt(s["acc"], x["part"])), schema)).alias("acc"))
        state, _ = _serial(rows, ["part"], {"acc": F.lit(None).cast("string")}, step, None, None, segment=segment)
        return _merged(state.select("doc_id", F.col("acc").alias("text"), _schema_error(F.col("acc"), schema).alias("error"),
                                    F.array("acc").alias("rest")))

    def advance(part):
        names = ["doc_id", "chunk_idx", "acc", "failed", "rest"]
        opening = part.where("acc is null").withColumn("acc", F.col("part")).withColumn("rest", F.array("part"))
        # After a failure the parts are only gathered.
        stopped = part.where("acc is not null and failed is not null").withColumn("rest", F.concat("rest", F.array("part")))
        asked = part.where("acc is not null and failed is null").withColumn("system", system).withColumn("user", prompt(F.col("acc"), F.col("part")))
        replied = ask(asked, model, schema, **limits)
        good = F.col("error").isNull()
        moved = (replied.withColumn("acc", F.when(good, _settled(F.col("reply"), schema)).otherwise(F.col("acc"))).withColumn("failed", F.col("error"))
                 .withColumn("rest", F.when(good, F.array("acc")).otherwise(F.concat("rest", F.array("part")))))
        return moved.select(*names).unionByName(opening.select(*names)).unionByName(stopped.select(*names))

    seed = rows.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("acc"), _no_error().alias("failed"),
                                                   F.array().cast("array<string>").alias("rest"))
    state, _ = _rounds(rows, seed, advance, [])
    return _merged(state.select("doc_id", F.col("acc").alias("text"), F.col("failed").alias("error"), "rest"))


def _merged(done: DataFrame) -> DataFrame:
    failed = F.col("error").isNotNull()
    return done.select("doc_id", F.when(~failed, F.col("text")).alias("summary"), "error", F.when(failed, F.col("rest")).alias("unmerged"))


def _tree_place(idx: Column, n: Column) -> Column:
    """(depth, code) of leaf ``idx`` of ``n`` when halving at floor(n / 2) from the root."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), n.cast("long").alias("n"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("code"))

    def descend(s, _i):
        half = F.floor(s["n"] / 2).cast("long")
        left = idx < s["lo"] + half
        return F.when(s["n"] <= 1, s).when(left, F.struct(s["lo"].alias("lo"), half.alias("n"), (s["depth"] + 1).alias("depth"), (s["code"] * 2).alias("code"))).otherwise(
            F.struct((s["lo"] + half).alias("lo"), (s["n"] - half).alias("n"), (s["depth"] + 1).alias("depth"), (s["code"] * 2 + 1).alias("code")))
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n.cast("double"))).cast("int"), F.lit(1)))
    return F.aggregate(steps, start, descend)


def merge_tree(parts: DataFrame, model, guidance: str = "", schema: dict | None = None, **limits) -> DataFrame:
    """(doc_id, summary, error, unmerged) from ``parts`` merged pairwise along a balanced tree, with
    errors as in ``merge_left_to_right``: above a failed pair nothing is asked, all texts are kept.

    All documents and all pairs of a level are merged in parallel; with a ColumnModel
    ``TREE_LEVELS`` levels share one shuffle.
    """
    system = F.lit(system_prompt("merge", guidance, schema))
    is_json = schema is not None
    prompt = lambda a, b: merge_prompt(as_json(a, is_json), as_json(b, is_json), guidance)
    sizes = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 1
    depth = math.ceil(math.log2(most)) if most > 1 else 0
    placed = parts.join(sizes, "doc_id").withColumn("_t", _tree_place(F.col("chunk_idx"), F.col("_n")))
    nodes = placed.select("doc_id", F.col("_t.depth").alias("depth"), F.col("_t.code").alias("code"), F.coalesce("summary", F.lit("")).alias("text"))
    if isinstance(model, ColumnModel):
        while depth > 0:
            top = ((depth - 1) // TREE_LEVELS) * TREE_LEVELS
            drop = F.greatest(F.col("depth") - top, F.lit(0))
            ancestor = F.floor(F.col("code") / F.pow(F.lit(2.0), drop)).cast("long")
            subtree = nodes.groupBy("doc_id", F.least("depth", F.lit(top)).alias("_d"), ancestor.alias("_c"))
            # Sorted by position: codes aligned to the deepest level.
            pos = F.floor(F.col("code") * F.pow(F.lit(2.0), F.lit(depth) - F.col("depth"))).cast("long")
            held = subtree.agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), "depth", "code", "text"))).alias("items"))

            def level(items, d):
                def join(x, i):
                    pair = F.get(items, i + 1)
                    merged = _settled(model.reply(system, prompt(x["text"], pair["text"])), schema)
                    node = F.struct(x["pos"].alias("pos"), (x["depth"] - 1).alias("depth"), F.floor(x["code"] / 2).cast("long").alias("code"), merged.alias("text"))
                    return F.when(x["depth"] < d, x).when(x["code"] % 2 == 0, node)
                return F.filter(F.transform(items, join), lambda x: x.isNotNull())
            folded = F.aggregate(F.sequence(F.lit(depth), F.lit(top + 1), F.lit(-1)), F.col("items"), level)
            nodes = held.select("doc_id", F.col("_d").alias("depth"), F.col("_c").alias("code"), folded[0]["text"].alias("text"))
            depth = top
        return _merged(nodes.select("doc_id", "text", _schema_error(F.col("text"), schema).alias("error"), F.array("text").alias("rest")))
    nodes = nodes.withColumn("error", _no_error()).withColumn("rest", F.array("text"))
    for d in range(depth, 0, -1):
        side = lambda k: F.max(F.when(F.col("code") % 2 == k, F.struct("text", "error", "rest")))
        pairs = nodes.where(F.col("depth") == d).groupBy("doc_id", F.floor(F.col("code") / 2).cast("long").alias("code")).agg(side(0).alias("a"), side(1).alias("b"))
        both = pairs.select("doc_id", "code", "a", "b", F.coalesce("a.error", "b.error").alias("failed"), F.concat("a.rest", "b.rest").alias("rest"))
        asked = both.where("failed is null").withColumn("system", system).withColumn("user", prompt(F.col("a.text"), F.col("b.text")))
        replied = ask(asked, model, schema, **limits)
        text = F.when(F.col("error").isNull(), _settled(F.col("reply"), schema))
        merged = replied.select("doc_id", F.lit(d - 1).alias("depth"), "code", text.alias("text"), "error",
                                F.when(F.col("error").isNull(), F.array(text)).otherwise(F.col("rest")).alias("rest"))
        stopped = both.where("failed is not null").select("doc_id", F.lit(d - 1).alias("depth"), "code", F.lit(None).cast("string").alias("text"),
                                                          F.col("failed").alias("error"), "rest")
        nodes = cut_lineage(nodes.where(F.col("depth") < d).unionByName(merged).unionByName(stopped))
    return _merged(nodes.select("doc_id", "text", "error", "rest"))


def summarize_merge(parts: DataFrame, model, merge_mode: str = "left-to-right", **kw) -> DataFrame:
    if merge_mode not in ("left-to-right", "hierarchical"):
        raise ValueError(f"unsupported merge_mode: {merge_mode}")
    return (merge_tree if merge_mode == "hierarchical" else merge_left_to_right)(parts, model, **kw)


def summarize_map_merge(chunks: DataFrame, model, group: str, guidance: str = "", merge_guidance: str = "",
                        merge_mode: str = "left-to-right", schema: dict | None = None, before: int = 0, after: int = 0,
                        **limits) -> tuple[DataFrame, DataFrame]:
    """((doc_id, summary, error, unmerged), per-chunk summaries); context is not wrapped in this method."""
    parts = summarize_map(chunks, model, group, guidance, schema, before, after, wrap=False, **limits)
    if isinstance(model, BatchModel):
        parts = cut_lineage(parts)
    return summarize_merge(parts, model, merge_mode, guidance=merge_guidance, schema=schema, **limits), parts


# --- one entry point -------------------------------------------------------------------------------------

def set_annotation(annotations: Column, field: str, value: Column) -> Column:
    """JSON object text with member ``field`` set to the JSON text ``value``."""
    entries = F.coalesce(F.map_entries(F.from_json(annotations, "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    others = F.transform(F.filter(entries, lambda e: e["key"] != field),
                         lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    new = F.concat(json_string(F.lit(field)), F.lit(":"), value)
    return F.when(value.isNull(), annotations).otherwise(F.concat(F.lit("{"), F.array_join(F.concat(others, F.array(new)), ","), F.lit("}")))


def summarize(docs: DataFrame, chunks: DataFrame, model, method: str, group: str | None = None, *, schema: dict | None = None,
              annotation_field: str = "summary", annotation_field_delta: str = "summary_delta", tokens_budget: int | None = None,
              merge_mode: str = "left-to-right", merge_guidance: str = "", initial_summary=None, json_sum: str = "append",
              guidance: str = "", before: int = 0, after: int = 0, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotated (docs, chunks) by one of ``METHODS``, and the errors (doc_id, chunk_idx, error); ``chunk_idx``
    is null where the error is the document's. Inputs carry resolved content."""
    from docflow.functions.jsonx import annotation
    if method not in METHODS:
        raise ValueError(f"unsupported summarization method: {method}")
    if method != "full" and group is None:
        raise ValueError("chunk_group is required")
    json_of = lambda c: as_json(c, schema is not None)
    common = dict(guidance=guidance, schema=schema, **limits)
    context = dict(before=before, after=after)
    doc_rows = chunk_rows = None
    field = annotation_field
    if method == "full":
        doc_rows = summarize_full(docs, model, **common).select("doc_id", json_of(F.col("summary")).alias("_v"), "error")
    elif method == "map":
        rows = (summarize_map_budget(chunks, model, group, tokens_budget, **common, **context) if tokens_budget
                else summarize_map(chunks, model, group, **common, **context))
        chunk_rows = rows.select("doc_id", "chunk_idx", json_of(F.col("summary")).alias("_v"), "error")
    elif method == "fold":
        doc_rows = summarize_fold(chunks, model, group, initial_summary=initial_summary or "", **common, **context).select("doc_id", json_of(F.col("summary")).alias("_v"), "error")
    elif method == "delta-fold":
        seeds = None
        if initial_summary is not None:
            seeds = docs.select("doc_id", F.lit(initial_summary).alias("deltas"))
        elif json_sum == "append":
            old = annotation(F.col("annotations"), field)
            seeds = docs.select("doc_id", old.alias("deltas")).where(json_kind(F.try_parse_json("deltas")) == "ARRAY")
        whole, deltas = summarize_delta_fold(chunks, model, group, json_sum=json_sum, initial=seeds, **common, **context)
        doc_rows = whole.select("doc_id", F.col("summary").alias("_v"), _no_error().alias("error"))
        chunk_rows = deltas.select("doc_id", "chunk_idx", json_of(F.col("delta")).alias("_v"), "error")
    elif method == "merge":
        parts = chunks.where(F.col("chunk_group") == group).select("doc_id", "chunk_idx", annotation(F.col("annotations"), field).alias("summary"))
        doc_rows = summarize_merge(parts, model, merge_mode, guidance=merge_guidance, schema=schema, **limits).select("doc_id", json_of(F.col("summary")).alias("_v"), "error")
    else:
        merged, parts = summarize_map_merge(chunks, model, group, guidance, merge_guidance, merge_mode, schema, before, after, **limits)
        doc_rows = merged.select("doc_id", json_of(F.col("summary")).alias("_v"), "error")
        chunk_rows = parts.select("doc_id", "chunk_idx", json_of(F.col("summary")).alias("_v"), "error")
    errors = None
    if doc_rows is not None:
        errors = doc_rows.select("doc_id", F.lit(None).cast("int").alias("chunk_idx"), "error")
        docs = docs.join(doc_rows.drop("error"), "doc_id", "left").withColumn("annotations", set_annotation(F.col("annotations"), field, F.col("_v"))).drop("_v")
    if chunk_rows is not None:
        name = annotation_field_delta if method == "delta-fold" else field
        failed = chunk_rows.select("doc_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), "error")
        errors = failed if errors is None else errors.unionByName(failed)
        joined = chunks.join(chunk_rows.drop("error").withColumn("chunk_group", F.lit(group)), ["doc_id", "chunk_group", "chunk_idx"], "left")
        chunks = joined.withColumn("annotations", set_annotation(F.col("annotations"), name, F.col("_v"))).drop("_v")
    return docs, chunks, errors.where("error is not null")
