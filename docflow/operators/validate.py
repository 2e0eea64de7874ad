"""Request tables: rows that can run, and rejects with the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, str]


def REQUIRED(name: str) -> Rule:
    return F.col(name).isNotNull(), f"{name} is required"


def NON_EMPTY(name: str) -> Rule:
    return F.coalesce(F.col(name) != "", F.lit(False)), f"{name} is required"


def POSITIVE_INT(name: str) -> Rule:
    return F.coalesce(F.col(name).cast("double") >= 1, F.lit(False)), f"{name} must be a positive integer"


def ONE_OF(name: str, values: Sequence[str]) -> Rule:
    return F.coalesce(F.col(name).isin(*values), F.lit(False)), f"unsupported {name}"


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with ``reason``): the first rule that does not hold names it."""
    reason = F.coalesce(*[F.when(~ok, F.lit(text)) for ok, text in rules])
    return df.where(reason.isNull()), df.withColumn("reason", reason).where(F.col("reason").isNotNull())
