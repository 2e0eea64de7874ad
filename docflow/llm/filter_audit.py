"""How filters of a corpus interact: what each removes in every order of applying them.

Every row gets a mask with a bit for each filter it fails. What an order does depends on the masks only,
so rows are counted by part and mask first, and at most 2^filters counts of each part give all orders.
One filter, the last letter, removes copies: rows whose text a row with a smaller id has, found by ``text_trie``.

Defined cases: a null text counts as empty; a null part as the empty string; a row's labels are those of its id,
and of several label rows any counts; rows without labels are neither good nor toxic; copies as in
``text_trie``; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.scratch import scratch_dir
from docflow.llm.text_trie import RANGE_BYTES, copy_flags

BREAK = r"[\x20\x09-\x0D]+"


def default_failures() -> dict[str, Column]:
    """Failure conditions over ``text`` and its ``words``."""
    words = F.size("words")
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": words < 200, "B": 100 * F.size(F.array_distinct("words")) < 50 * words,
            "C": 100 * capitals > 2 * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}


def masked(docs: DataFrame, failures: dict[str, Column], part: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, part, mask): the bits of ``mask`` are the ``failures``, in their order."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    worded = rows.withColumn("words", F.filter(F.split("text", BREAK), lambda w: w != ""))
    bits = [F.when(condition, 1 << k).otherwise(0) for k, condition in enumerate(failures.values())]
    return worded.select("doc_id", "text", "part", reduce(Column.bitwiseOR, bits).alias("mask"))


def mask_counts(flags: DataFrame, labels: DataFrame, copies: int) -> DataFrame:
    """(part, mask, n, good, toxic): rows by mask; ``copies`` is the bit of the copy filter."""
    known = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    mask = F.col("mask").bitwiseOR(F.when(F.col("copy"), copies).otherwise(0))
    of = lambda label: F.sum(F.col("n") * F.coalesce(label, F.lit(0))).alias(label)
    return flags.join(known, "doc_id", "left").groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """What every step of every order of ``letters`` (bit k stands for letter k) keeps and removes, by part."""
    bit = lambda letter: F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)]), letter)
    at = lambda step: F.substring(F.col("filter_order"), step, F.lit(1))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = rows.select("part", "masks", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    rows = rows.select("*", bit(at(F.col("step"))).alias("own"), F.aggregate(
        F.filter(F.sequence(F.lit(1), F.lit(len(letters))), lambda i: i < F.col("step")), F.lit(0), lambda all, i: all.bitwiseOR(bit(at(i)))).alias("before"))
    own, before, none = F.col("own"), F.col("before"), F.lit(0)

    def total(value, when=None) -> Column:
        chosen = F.filter("masks", when) if when else F.col("masks")
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda sum, m: sum + value(m))

    fails = lambda m: m["mask"].bitwiseAND(own) != none
    gone = lambda m: m["mask"].bitwiseAND(before) != none
    removed = lambda m: fails(m) & ~gone(m)
    # A filter comes first among the k filters a row fails in one of k orders.
    count = factorial(len(letters))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda m: m["n"], lambda m: ~fails(m) & ~gone(m)).alias("kept"), total(lambda m: m["n"], removed).alias("removed"),
        total(lambda m: m["n"], lambda m: fails(m) & gone(m)).alias("redundant"), total(lambda m: m["n"], lambda m: m["mask"] == own).alias("unique_fails"),
        total(lambda m: m["good"], removed).alias("good_lost"), total(lambda m: m["toxic"], removed).alias("toxic_lost"),
        total(lambda m: m["n"] * (F.lit(count) / F.bit_count(m["mask"])).cast("long"), fails).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, copies: str = "E", part: str = "source",
          text: str = "text", doc_id: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    failures = failures or default_failures()
    rows = masked(docs, failures, part, text, doc_id)
    flags = copy_flags(rows, ["part", "mask"], scratch_dir(docs.sparkSession), range_bytes)
    return interactions(mask_counts(flags, labels, 1 << len(failures)), "".join(failures) + copies)
