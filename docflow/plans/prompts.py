"""Prompts of the summarisation methods."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import json_string
from docflow.operators.ordering import TEXT_BLOCK, with_frames
from docflow.operators.tree import GROUP, owned

_ROLE = "You summarise documents."
_GUIDED = "Follow this guidance:\n<guidance>\n{guidance}\n</guidance>"
SYSTEM = {
    "full": f"{_ROLE} The user provides a whole document; summarise it.\n\n{_GUIDED}",
    "map": f"{_ROLE} The document comes in chunks. Summarise exactly the current chunk; neighbouring chunks may be "
           f"given as context. Obey <constraint> elements of the prompt.\n\n{_GUIDED}",
    "fold": f"{_ROLE} You get one chunk and the summary so far. Return the summary in the same form, extended by "
            f"what is new in the chunk, without losing what matters in it.\n\n{_GUIDED}",
    "delta-fold": f"{_ROLE} You get one chunk and the list of summaries so far. Return only what is new in this "
                  f"chunk, as valid JSON; it is appended to the list.\n\n{_GUIDED}",
    "merge": f"{_ROLE} You get two partial summaries. Merge them into one by the guidance given. Return only the merged summary.",
}
RULE = "\n\n"      # between the parts of a prompt
SQRT2 = 2 ** 0.5


def system_prompt(mode: str, guidance: str = "", schema: dict | None = None) -> str:
    """System text of a mode; a JSON Schema adds the demand for conforming JSON."""
    text = SYSTEM[mode].replace("{guidance}", guidance)
    if schema is None:
        return text
    return (f"{text}\n\nThe whole reply must be valid JSON that conforms to this schema, without comments around it:\n\n"
            f"{json.dumps(schema, indent=2, ensure_ascii=False)}\n")


def wrapped(chunk_id: Column, content: Column) -> Column:
    return F.concat(F.lit('<chunk id="'), chunk_id, F.lit('">\n'), content, F.lit("\n</chunk>"))


def with_context(chunks: DataFrame, before: int = 0, after: int = 0, wrap: bool = True) -> DataFrame:
    """Add ``preceding`` and ``succeeding``: the texts of up to ``before`` / ``after``
    neighbours, each in a ``<chunk>`` element if ``wrap``, joined by a blank line."""
    text = wrapped(F.col("chunk_id"), F.col("content")) if wrap else F.col("content")
    rows = chunks.withColumn("_text", text)
    frames = {}
    if before:
        frames["_before"] = (F.collect_list("_text"), -before, -1)
    if after:
        frames["_after"] = (F.collect_list("_text"), 1, after)
    if frames:
        rows = with_frames(owned(rows), GROUP, "chunk_idx", before, after, frames, TEXT_BLOCK)
    joined = lambda name, on: F.array_join(name, "\n\n") if on else F.lit("")
    return (rows.withColumn("preceding", joined("_before", before)).withColumn("succeeding", joined("_after", after))
            .drop("_text", "_before", "_after"))


def context_parts(wrap: bool = True) -> tuple[Column, Column]:
    """(text before the accumulated summary's place, text after it) of a chunk prompt."""
    metadata = F.coalesce("metadata", F.lit("{}"))
    chunk = wrapped(F.col("chunk_id"), F.col("content")) if wrap else F.col("content")
    body = F.concat(
        F.when(F.col("preceding") != "", F.concat(F.lit("[before]\n"), "preceding", F.lit(RULE))).otherwise(""),
        F.lit("[metadata]\n"), metadata, F.lit("\n\n[chunk]\n"), chunk,
        F.when(F.col("succeeding") != "", F.concat(F.lit(f"{RULE}[after]\n"), "succeeding")).otherwise(""))
    head = F.concat(F.lit("[document] "), "doc_id", F.lit("\n"))
    return head, body


def full_prompt() -> Column:
    return F.concat(F.lit("[document] "), "doc_id", F.lit("\n[metadata]\n"),
                    F.coalesce("metadata", F.lit("{}")), F.lit("\n\n[text]\n"), "content")


def chunk_prompt(wrap: bool = True) -> Column:
    head, body = context_parts(wrap)
    return F.concat(head, body)


def fold_prompt(head: Column, body: Column, summary: Column) -> Column:
    """Chunk prompt with the summary so far (JSON text), left out while it is empty."""
    so_far = F.when(summary.isNotNull() & (summary != '""'),
                    F.concat(F.lit("[summary so far]\n"), summary, F.lit(RULE))).otherwise("")
    return F.concat(head, so_far, body)


def delta_prompt(head: Column, body: Column, deltas: Column) -> Column:
    """Chunk prompt with the JSON array of deltas so far."""
    return F.concat(head, F.lit("[summaries so far]\n"), deltas, F.lit("\n\n"), body)


def merge_prompt(a: Column, b: Column, guidance: str = "") -> Column:
    """Prompt to merge two partial summaries (JSON texts)."""
    return F.concat(F.lit("Merge the two.\n\n[first]\n"), a, F.lit("\n\n[second]\n"), b,
                    F.lit(f"\n\n[guidance]\n{guidance or '(none)'}\n\nReturn one merged summary.\n"))


# Fixed value: the form of a length constraint.
CONSTRAINT = ("<constraint> Do not use more than ", " words.  Do not use less than ", " words. </constraint>")


def word_constraint(words: Column) -> Column:
    """Limits a factor of √2 around a word target, as a prompt line."""
    shown = lambda c: F.floor(c + 0.5).cast("long").cast("string")
    return F.concat(F.lit(CONSTRAINT[0]), shown(words * SQRT2), F.lit(CONSTRAINT[1]), shown(words / SQRT2), F.lit(CONSTRAINT[2]))


def as_json(value: Column, is_json: bool) -> Column:
    """A reply as JSON text: quoted unless it already is JSON."""
    return value if is_json else json_string(value)
