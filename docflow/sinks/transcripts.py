"""Transcript outputs: JSON, batch request files, attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions.dataurl import decode_data_url
from docflow.operators.transcripts import transcripts_json
from docflow.plans.render import RequestOptions, render_requests
from docflow.sinks.files import write_files


def write_transcripts(turns: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One transcript object per line, each with its conversation id. Turns of conversations
    too long for a line go to ``<path>.parts`` as a table."""
    everything = transcripts_json(turns)
    rows = everything.where(F.col("json").isNotNull())
    value = F.concat(F.lit('{"conv_id":'), F.substring(F.to_json(F.array("conv_id")), F.lit(2), F.length(F.to_json(F.array("conv_id"))) - 2),
                     F.lit(","), F.substring("json", F.lit(2), F.length("json")))
    rows.select(value.alias("value")).write.mode(mode).text(path)
    large = everything.where(F.col("json").isNull()).select("conv_id")
    if not large.isEmpty():
        turns.join(large, "conv_id", "left_semi").write.mode(mode).parquet(f"{path}.parts")


def batch_lines(requests: DataFrame, provider: str, model: str) -> DataFrame:
    """(provider, model, conv_id, value): one JSON line per request with its id; NULL for a request without a body."""
    value = F.concat(F.lit('{"custom_id":'), F.to_json(F.array("conv_id")).substr(F.lit(2), F.length(F.to_json(F.array("conv_id"))) - 2),
                     F.lit(',"body":'), "body", F.lit("}"))
    return requests.select(F.lit(provider).alias("provider"), F.lit(model).alias("model"), "conv_id", value.alias("value"))


def write_batch_requests(turns: DataFrame, providers: dict[str, RequestOptions], path: str, mode: str = "errorifexists") -> None:
    """Batch request files for offline submission, partitioned by provider and model.

    Conversations whose request could not be built go to ``<path>.rejects`` with the reason.
    """
    out = None
    for provider, options in providers.items():
        lines = batch_lines(render_requests(turns, provider, options), provider, options.model)
        out = lines if out is None else out.unionByName(lines)
    out.where("value IS NOT NULL").drop("conv_id").write.mode(mode).partitionBy("provider", "model").text(path)
    lost = out.where("value IS NULL").select("provider", "model", "conv_id", F.lit("text_too_long").alias("reason"))
    if not lost.isEmpty():
        lost.write.mode(mode).parquet(f"{path}.rejects")


def attachment_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, kind, filename, mime, content) of image and document parts."""
    rows = turns.select("conv_id", "turn", F.posexplode("parts").alias("pos", "p")).where(F.col("p.kind").isin("image", "document"))
    image = decode_data_url(F.col("p.url"))
    is_image = F.col("p.kind") == "image"
    return rows.select("conv_id", "turn", "pos", F.col("p.kind").alias("kind"), F.col("p.filename").alias("filename"),
                       F.when(is_image, image["mime"]).alias("mime"),
                       F.when(is_image, image["content"]).otherwise(F.encode("p.text", "UTF-8")).alias("content"),
                       F.when(is_image & image["content"].isNull(), F.lit("Invalid data URL")).alias("reason"))


def write_attachments(turns: DataFrame, path: str, mode: str = "errorifexists") -> None:
    attachment_rows(turns).write.mode(mode).parquet(path)


def attachment_files(turns: DataFrame) -> DataFrame:
    """(name, content) of the attachments as files: ``<conversation>/<turn>-<position>-<file name>``, images by their type."""
    rows = attachment_rows(turns).where("reason IS NULL")
    ending = F.regexp_extract("mime", r"/([a-z0-9]+)", 1)
    named = F.coalesce(F.regexp_extract("filename", r"([^/\\]+)$", 1), F.concat(F.lit("image."), ending))
    safe = F.regexp_replace(F.col("conv_id").cast("string"), r"[^A-Za-z0-9_-]", "_")
    return rows.select(F.concat(safe, F.lit("/"), F.col("turn").cast("string"), F.lit("-"), F.col("pos").cast("string"), F.lit("-"), named).alias("name"), "content")


def write_attachment_files(turns: DataFrame, path: str) -> None:
    write_files(attachment_files(turns), path)
