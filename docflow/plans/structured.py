"""Asking a model with guarantees: non-empty replies, replies that fit a schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import reply_json
from docflow.functions.schema_check import violations
from docflow.plans.models import BatchModel, ColumnModel, complete, complete_distinct
from docflow.schemas import ERROR
from docflow.session import cut_lineage

# Default limits (N attempts allowed mean N + 1 calls), and the two error messages, which
# clients compare.
MAX_REPAIRS = 5
MAX_DEFECTIVE = 5
EXHAUSTED = "Exhausted num_defective_reply_max_attempts.  Something seems to be wrong with this model or prompt."
INVALID = "The response could not be validated after multiple attempts."
HISTORY = "array<struct<role:string,content:string>>"

REPAIR_TASK = ("Your last reply breaks the schema in the places listed here. Send it again with these places mended and nothing else "
               "changed. Invent no facts: where the schema offers a word for \"not known\", use it; leave out an optional part that "
               "cannot be filled.")


def failure(message: str, kind: str, code: int, details: Column | None = None) -> Column:
    return F.struct(F.lit(None).cast("string").alias("provider"), F.lit(message).alias("message"), F.lit("Error").alias("name"),
                    F.lit(None).cast("int").alias("status"), F.lit(kind).alias("interpreted_type"), F.lit(code).alias("interpreted_code"),
                    F.lit(message if code == 422 else "An error occurred while processing your request.").alias("interpreted_message"),
                    (details if details is not None else F.lit(None).cast("string")).alias("details")).cast(ERROR)


def defective() -> Column:
    return F.col("error").isNull() & (F.col("reply").isNull() | (F.col("reply") == ""))


def complete_with_retry(requests: DataFrame, model: ColumnModel | BatchModel, max_attempts: int = MAX_DEFECTIVE) -> DataFrame:
    """``complete``; empty replies are asked again, only those, ``max_attempts`` times."""
    gone = F.when(defective(), failure(EXHAUSTED, "unclassified_api_error", 500)).otherwise(F.col("error"))
    if isinstance(model, ColumnModel):
        # A column gives the same reply each time, so asking again cannot help.
        return complete(requests, model).withColumn("error", gone)
    pending, settled = requests.withColumn("attempt", F.lit(0)), None
    for attempt in range(max_attempts + 1):
        out = complete(pending, model)
        keep = out if attempt == max_attempts else out.where(~defective())
        settled = keep if settled is None else settled.unionByName(keep)
        if attempt == max_attempts:
            break
        pending = out.where(defective()).drop("reply", "error").withColumn("attempt", F.lit(attempt + 1))
        if pending.isEmpty():
            break
    return settled.withColumn("error", gone).drop("attempt")


def repair_prompt(reply: Column, found: Column) -> Column:
    """Prompt that lists the violations of a reply, then shows it, and asks for one without them."""
    shown = F.transform(found, lambda v: F.struct(
        v["instance_path"].alias("instancePath"), v["keyword"].alias("keyword"), v["message"].alias("message")))
    return F.concat(F.lit(f"{REPAIR_TASK}\n\nProblems, as JSON:\n"), F.to_json(shown), F.lit("\n\nYour reply was:\n"), reply, F.lit("\n"))


def complete_structured(requests: DataFrame, model: ColumnModel | BatchModel, schema: dict, max_repairs: int = MAX_REPAIRS,
                        max_attempts: int = MAX_DEFECTIVE) -> DataFrame:
    """Replies that conform to ``schema``; invalid ones are repaired in bounded rounds.

    A round asks only the rows still invalid, with the reply and a repair prompt appended to
    ``history``. What stays invalid ends with a ``schema_validation_failed`` error whose
    details hold the most valid and the final reply. ``repairs`` counts the rounds used.
    """
    pending = requests.withColumn("history", F.array().cast(HISTORY)).withColumn("_best", F.lit(None).cast("string"))
    settled = None
    for attempt in range(max_repairs + 1):
        last = attempt == max_repairs
        asked = pending
        if isinstance(model, ColumnModel):
            # A column model sees one user text: the first prompt and all that followed.
            turns = F.transform("history", lambda m: F.concat(F.lit("\n\n"), m["role"], F.lit(": "), m["content"]))
            asked = pending.withColumn("_user", F.col("user")).withColumn("user", F.concat("user", F.array_join(turns, "")))
        out = complete_with_retry(asked, model, max_attempts)
        if isinstance(model, ColumnModel):
            out = out.drop("user").withColumnRenamed("_user", "user")
        checked = out.withColumn("violations", F.when(F.col("error").isNull(), violations(F.col("reply"), schema)))
        if not last:
            checked = cut_lineage(checked)
        invalid = F.coalesce(F.size("violations") > 0, F.lit(False))
        done = (checked if last else checked.where(~invalid)).withColumn("repairs", F.lit(attempt))
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        again = F.concat("history", F.array(
            F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")),
            F.struct(F.lit("user").alias("role"), repair_prompt(F.col("reply"), F.col("violations")).alias("content"))))
        pending = (checked.where(invalid).withColumn("_best", F.coalesce(reply_json(F.col("reply")), F.col("_best")))
                   .withColumn("history", again.cast(HISTORY)).drop("reply", "error", "violations"))
        if pending.isEmpty():
            break
    invalid = F.coalesce(F.size("violations") > 0, F.lit(False))
    final = F.to_json(F.array("reply"))
    details = F.concat(F.lit('{"mostValidOutput":'), F.coalesce("_best", F.lit("null")), F.lit(',"finalResponse":'),
                       F.substring(final, F.lit(2), F.length(final) - 2), F.lit("}"))
    return settled.withColumn("error", F.when(invalid, failure(INVALID, "schema_validation_failed", 422, details)).otherwise(F.col("error"))).drop("_best")


def response_format(schema: dict, name: str = "forced-schema") -> str:
    """Request option that asks a provider for schema-conforming output, as JSON."""
    return json.dumps({"type": "json_schema", "json_schema": {"name": name, "schema": schema}})


def ask(requests: DataFrame, model: ColumnModel | BatchModel, schema: dict | None = None, max_repairs: int | None = None,
        max_attempts: int | None = None, distinct: bool = False) -> DataFrame:
    """One call per request by the rules in force: retry of empty replies and, with a
    schema, validation and repair. ``distinct`` asks equal prompts once."""
    attempts = MAX_DEFECTIVE if max_attempts is None else max_attempts
    if schema is not None:
        return complete_structured(requests, model, schema, MAX_REPAIRS if max_repairs is None else max_repairs, attempts)
    if distinct:
        return complete_distinct(requests, model)
    return complete_with_retry(requests, model, attempts)
