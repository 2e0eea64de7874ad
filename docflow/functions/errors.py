"""Errors of model calls as data: triage, JSON form, retry plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import json_kind, member
from docflow.schemas import ERROR

# Messages that tell a content filter intervened.
CONTENT_FILTER = (
    "content_filter", "content policy violation", "content was filtered", "violated content policy",
    "inappropriate content", "content_policy_violation", "responsibleaipolicy", "responsibleaipolicyviolation",
    "the response was filtered due to the prompt triggering azure openai", "content management policy",
    "modify your prompt and retry", "azure has not provided the response due to a content filter",
    "content filter being triggered",
)
# Message patterns and texts of the other classes.
CONTEXT_OVERFLOW = "(?i)maximum context length|too many tokens"
RATE_LIMIT = ("rate limit", "too many requests")
AUTHENTICATION = ("unauthorized", "invalid api key", "authentication")
QUOTA = ("quota", "insufficient_quota", "billing")
# What callers are told per class.
MESSAGES = {
    "content_filter_violation": "Content was filtered due to policy violations. Please try with different content.",
    "context_overflow": "Too many tokens for model",
    "rate_limit": "Rate limit exceeded. Please try again later.",
    "authentication": "Authentication failed. Please check API credentials.",
    "quota_exceeded": "API quota exceeded. Please check your billing and usage limits.",
    "unclassified_api_error": "An error occurred while processing your request.",
}
# Retry back-off.
BACKOFF_BASE_MS, BACKOFF_CAP_MS = 250, 8000


def _mentions(text: Column, needles) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def classify_errors(df: DataFrame) -> DataFrame:
    """Add interpreted_type, interpreted_code and interpreted_message to rows of
    (status, code, message[, inner_code, finish_reason, filtered])."""
    column = lambda name, typ: F.col(name) if name in df.columns else F.lit(None).cast(typ)
    status = F.col("status")
    text = F.lower(F.coalesce("message", F.lit("")))
    code = F.lower(F.coalesce("code", F.lit("")))
    no = F.lit(False)
    filtered = (_mentions(text, CONTENT_FILTER) | _mentions(code, CONTENT_FILTER)
                | F.coalesce((status == 400) & text.contains("filter"), no)
                | F.coalesce(column("inner_code", "string") == "ResponsibleAIPolicyViolation", no)
                | F.coalesce(column("finish_reason", "string") == "content_filter", no)
                | F.coalesce(column("filtered", "boolean"), no))
    overflow = F.coalesce((status == 400) & F.coalesce("message", F.lit("")).rlike(CONTEXT_OVERFLOW), no)
    is_status = lambda n: F.coalesce(status == n, no)
    kind = (F.when(filtered, "content_filter_violation").when(overflow, "context_overflow")
            .when(is_status(429) | _mentions(text, RATE_LIMIT) | (code == "rate_limit_exceeded"), "rate_limit")
            .when(is_status(401) | _mentions(text, AUTHENTICATION) | (code == "invalid_api_key"), "authentication")
            .when(is_status(402) | _mentions(text, QUOTA) | (code == "insufficient_quota"), "quota_exceeded")
            .otherwise("unclassified_api_error"))
    fixed = {"content_filter_violation": 422, "rate_limit": 429, "authentication": 401, "quota_exceeded": 402}
    number = F.when(F.lit(False), 0)
    said = F.when(F.lit(False), "")
    for name, value in fixed.items():
        number = number.when(F.col("interpreted_type") == name, value)
    for name, value in MESSAGES.items():
        said = said.when(F.col("interpreted_type") == name, value)
    # A status of 0 is as good as none.
    number = number.otherwise(F.coalesce(F.when(status != 0, status), F.lit(500)))
    return (df.withColumn("interpreted_type", kind).withColumn("interpreted_code", number.cast("int"))
            .withColumn("interpreted_message", said))


def error_column(df: DataFrame, provider: str) -> DataFrame:
    """Fold classified columns into one ``error`` struct; NULL where ``message`` is NULL."""
    pick = lambda name: F.col(name) if name in df.columns else F.lit(None)
    whole = F.struct(F.lit(provider).alias("provider"), F.col("message"), pick("name").cast("string").alias("name"),
                     F.col("status").cast("int").alias("status"), "interpreted_type", F.col("interpreted_code").cast("int").alias("interpreted_code"),
                     "interpreted_message", pick("details").cast("string").alias("details")).cast(ERROR)
    return df.withColumn("error", F.when(F.col("message").isNotNull(), whole))


def errors_to_json(error: Column) -> Column:
    """JSON of a structured error, unset fields left out; plain errors as one string."""
    structured = error["provider"].isNotNull() | error["interpreted_type"].isNotNull()
    whole = F.to_json(F.struct(
        F.lit("Error").alias("exception"), error["name"].alias("nameOfInnerException"), error["provider"].alias("provider"),
        error["message"].alias("message"), error["interpreted_type"].alias("interpretedErrorType"),
        error["interpreted_code"].alias("interpretedCode"), error["interpreted_message"].alias("interpretedMessage"),
        F.try_parse_json(error["details"]).alias("details")))
    text = F.to_json(F.array(F.concat(F.coalesce(error["name"], F.lit("Error")), F.lit(": "), error["message"])))
    plain = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(error.isNull(), F.lit(None)).when(structured, whole).otherwise(plain)


def errors_from_json(text: Column) -> Column:
    """Error struct from JSON; NULL unless it is an object naming a provider, a class or
    an inner exception."""
    v = F.try_parse_json(text)
    field = lambda name, typ="string": F.try_variant_get(v, f"$.{name}", typ)
    known = ((json_kind(member(v, "provider")) == "STRING") | (json_kind(member(v, "interpretedErrorType")) == "STRING")
             | (json_kind(member(v, "nameOfInnerException")) == "STRING"))
    whole = F.struct(field("provider").alias("provider"),
                     F.coalesce(field("message"), field("interpretedMessage")).alias("message"),
                     field("nameOfInnerException").alias("name"), field("status", "int").alias("status"),
                     field("interpretedErrorType").alias("interpreted_type"), field("interpretedCode", "int").alias("interpreted_code"),
                     field("interpretedMessage").alias("interpreted_message"), F.to_json(member(v, "details")).alias("details")).cast(ERROR)
    return F.when(F.coalesce(known, F.lit(False)), whole)


def http_status(text: Column, fallback: int = 500) -> Column:
    """Status to answer an error with: its interpreted code if that is an integer."""
    code = F.try_variant_get(F.try_parse_json(text), "$.interpretedCode", "double")
    return F.when(code == F.floor(code), code.cast("int")).otherwise(F.lit(fallback))


def is_retryable(status: Column, aborted: Column) -> Column:
    """Throttling, time-outs, server errors and transport errors - but no aborts."""
    return ~F.coalesce(aborted, F.lit(False)) & (status.isNull() | (status == 0) | status.isin(408, 429) | (status >= 500))


def retry_plan(attempts: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Requests to send again, from ``attempts(request_id, attempt, ok, status, aborted)``.

    Only the latest attempt of a request counts; it is found by partial aggregation.
    ``backoff_cap_ms`` bounds the wait before the next attempt.
    """
    latest = attempts.groupBy("request_id").agg(
        F.max_by(F.struct("ok", "status", "aborted"), "attempt").alias("last"), F.max("attempt").alias("attempt"))
    due = latest.where(~F.col("last.ok") & (F.col("attempt") < max_attempts) & is_retryable(F.col("last.status"), F.col("last.aborted")))
    cap = F.least(F.lit(float(BACKOFF_CAP_MS)), BACKOFF_BASE_MS * F.pow(F.lit(2.0), F.col("attempt") - 1))
    return due.select("request_id", (F.col("attempt") + 1).alias("next_attempt"), cap.cast("long").alias("backoff_cap_ms"))
