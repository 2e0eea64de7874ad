"""Models. A model turns a request (system text, user text) into a reply or a vector.

``ColumnModel`` is a Column expression and runs inside Catalyst. ``BatchModel`` is a user
callable over Arrow batches (a remote service, a local network); it reports failures as
error records, so that a failed call is a row and never a failed task.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import bind
from docflow.schemas import ERROR
from docflow.session import cut_lineage

REPLY = f"reply string, error {ERROR}"
TOO_LONG = ('{"message":"prompt does not fit a request","name":"Error","interpreted_type":"context_overflow",'
            '"interpreted_code":400,"interpreted_message":"Too many tokens for model"}')


@dataclass(frozen=True)
class ColumnModel:
    """``fn(system, user, max_output_tokens) -> Column``; ``vector(text) -> Column``."""

    name: str
    fn: Callable[[Column, Column, Column], Column] | None = None
    vector: Callable[[Column], Column] | None = None

    def reply(self, system: Column, user: Column, max_output_tokens: Column | None = None) -> Column:
        limit = F.lit(None).cast("long") if max_output_tokens is None else max_output_tokens
        return self.fn(system, user, limit)


@dataclass(frozen=True)
class BatchModel:
    """``open() -> client`` runs once per task; ``call(client, request) -> reply text``.

    ``request`` is a dict of the request's columns plus ``options``. ``embed(client, texts)``
    gives one vector per text. ``parallelism`` spreads requests over that many tasks, since
    calls wait for a service and small inputs would otherwise share one task.
    """

    name: str
    open: Callable[[], object]
    call: Callable[[object, dict], str] | None = None
    embed: Callable[[object, Sequence[str]], Sequence[Sequence[float]]] | None = None
    parallelism: int | None = None
    timeout_ms: int | None = None
    options: dict = field(default_factory=dict)


def error_record(err: Exception, provider: str) -> dict:
    """A failure as data; ``status`` and ``code`` of the client's exception are kept."""
    return {"provider": provider, "message": str(err), "name": type(err).__name__,
            "status": getattr(err, "status", None), "interpreted_type": getattr(err, "interpreted_type", None),
            "interpreted_code": getattr(err, "interpreted_code", None), "interpreted_message": None,
            "details": traceback.format_exc(limit=1)}


def complete(requests: DataFrame, model: ColumnModel | BatchModel) -> DataFrame:
    """Add ``reply`` and ``error`` to ``requests(system, user[, max_output_tokens, …])``."""
    limit = F.col("max_output_tokens") if "max_output_tokens" in requests.columns else None
    # A prompt is NULL where a text was too long for one cell: no model takes it.
    too_long = F.when(F.col("user").isNull(), F.from_json(F.lit(TOO_LONG), ERROR))
    if isinstance(model, ColumnModel):
        return requests.withColumn("reply", model.reply(F.col("system"), F.col("user"), limit)).withColumn("error", too_long)
    unasked = requests.where(F.col("user").isNull()).withColumn("reply", F.lit(None).cast("string")).withColumn("error", too_long)
    requests = requests.where(F.col("user").isNotNull())
    if model.parallelism:
        requests = requests.repartition(model.parallelism)

    def run(batches):
        client = model.open()
        for pdf in batches:
            replies, errors = [], []
            for request in pdf.to_dict("records"):
                try:
                    replies.append(model.call(client, {**request, "options": {
                        **model.options, "timeout_ms": model.timeout_ms}}))
                    errors.append(None)
                except Exception as err:  # any failure of a call becomes data
                    replies.append(None)
                    errors.append(error_record(err, model.name))
            yield pdf.assign(reply=replies, error=errors)

    fields = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    # Written once: a lost task later re-reads replies instead of asking the model again.
    return cut_lineage(requests.mapInPandas(run, f"{fields}, {REPLY}").unionByName(unasked))


def complete_distinct(requests: DataFrame, model: ColumnModel | BatchModel) -> DataFrame:
    """``complete`` with each distinct (system, user) asked once and joined back.

    Copies of one prompt may be a third of all rows: they collapse map-side before the
    shuffle, and the join back fans the copies out over ``salts`` sub-keys.
    """
    keyed = requests.withColumn("_k", F.sha2(F.concat_ws("\x00", "system", "user"), 256))
    once = keyed.groupBy("_k").agg(F.first("system").alias("system"), F.first("user").alias("user"))
    answered = complete(once, model).select("_k", "reply", "error")
    return salted_join(keyed, answered, "_k").drop("_k")


SALTS = 16


def salted_join(many: DataFrame, one: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Left join of many rows to at most one row per key, hot keys spread over ``salts``
    partitions (the small side is repeated that often)."""
    # The salt is a function of the row, so a recomputed task sends it the same way.
    rest = [c for c, t in many.dtypes if c != key and not t.startswith(("map", "variant"))]
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*(rest or [key])), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


# --- simple models for checks ----------------------------------------------------------

def digest_model(name: str = "digest", size: int = 16) -> ColumnModel:
    """Replies with a hash of the whole prompt, so a check of replies checks prompts."""
    return ColumnModel(name, lambda system, user, _n: F.substring(F.sha2(F.concat(system, F.lit("\n"), user), 256), 1, size))


# The alphabet by frequency in European languages; any order gives the same counts.
COMMON_FIRST = "etaoinsrhldcumfpgwybvkxjqz"


def letter_frequencies(name: str = "letters") -> ColumnModel:
    """26 relative letter counts as a vector."""
    def vector(text: Column) -> Column:
        # Letters are taken out one after the other, common ones first, so each pass reads a shorter text.
        def without(state: Column, letter: Column) -> Column:
            return bind(F.replace(state["left"], letter, F.lit("")), lambda left: F.struct(
                left.alias("left"), F.concat(state["sizes"], F.array(F.length(left))).alias("sizes")))

        def sizes(low: Column) -> Column:
            start = F.struct(low.alias("left"), F.array(F.length(low)).alias("sizes"))
            return F.aggregate(F.array(*[F.lit(c) for c in COMMON_FIRST]), start, without, lambda state: state["sizes"])

        places = [COMMON_FIRST.index(chr(97 + i)) for i in range(26)]
        return bind(F.struct(bind(F.lower(text), sizes).alias("s"), F.greatest(F.length(text), F.lit(1)).alias("n")), lambda t: F.array(*[
            ((t["s"][k] - t["s"][k + 1]) / t["n"]).cast("float") for k in places]))
    return ColumnModel(name, vector=vector)
