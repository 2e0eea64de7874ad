"""Pages to documents: routing, failures, tags, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import comment_lines, json_number, json_object, normalize_vision_reply
from docflow.functions.text import json_string
from docflow.operators.ordering import concat_ordered, last_before, running_before
from docflow.schemas import as_chunks

# Separators between pages of a document.
PAGE_BOUNDARY = "\n\n<!-- page boundary -->\n\n"
BLANK_LINE = "\n\n"
# Routing defaults.
OCR_THRESHOLD = 0.7
VISION_CONFIDENCE = 0.9
NO_OUTPUT = "(No fallback output)"
# Wording of a failure page.
NOTICE_HEAD = ("<!-- TRANSCRIPTION FAILURE -->\n<!-- This page failed to transcribe due to an error -->\n\n"
               "# Transcription Failed\n\n**Error Type:** ")
NOTICE_TAIL = ("\n\n---\n\n*This content was generated because the --continue-on-failure flag was used and the "
               "transcription process encountered an error.*")
NOTICE_DESCRIPTION = ("This page contains a transcription failure notice because the original transcription "
                      "process failed.")


def with_metadata_comments(text: Column, metadata: Column) -> Column:
    """Text behind one ``<!-- METADATA key: value -->`` line per metadata entry."""
    return F.concat(F.array_join(comment_lines(metadata, "METADATA "), "\n"), F.lit("\n"), text)


def split_pages(df: DataFrame, text: str = "text", mark: str = "\f") -> DataFrame:
    """One trimmed page per piece of ``text`` between page marks."""
    from docflow.functions.text import trim_all
    rest = [c for c in df.columns if c != text]
    pieces = F.split(F.col(text), f"\\Q{mark}\\E", -1)
    return df.select(*rest, F.posexplode(pieces).alias("page_idx", "page")).select(
        *rest, "page_idx", trim_all(F.col("page")).alias("text"))


def page_metadata(doc: Column, idx: Column, method: Column, confidence: Column, model: Column,
                  first: Column, filename: Column, tags: Column | None = None) -> Column:
    """Metadata JSON of a page, keys in the order they print."""
    members = [("page_number", (idx + 1).cast("string")), ("text_extraction_method", json_string(method)),
               ("extraction_confidence", json_number(F.round(confidence, 3))),
               ("model_name", F.coalesce(json_string(model), F.lit("null"))), ("isFirstPage", first.cast("string")),
               ("originating_filename", json_string(F.coalesce(filename, F.lit("")))),
               ("originating_file_sha256", json_string(doc))]
    if tags is not None:
        members.append(("tags", F.when(F.size(tags) > 0, F.to_json(tags))))
    return json_object(*members)


def assemble_pages(pages: DataFrame, page_numbering: bool = True) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks) from ``pages(doc_id, page_idx, text, metadata[, annotations, comments])``.

    ``start`` runs over bare page texts and so does not index the document text (which has
    comments and separators); ``content_start`` does. ``comments`` overrides the comment
    block where only some metadata keys are printed.
    """
    sep = PAGE_BOUNDARY if page_numbering else BLANK_LINE
    printed = (F.concat("comments", "text") if "comments" in pages.columns
               else with_metadata_comments(F.col("text"), F.col("metadata")))
    rows = pages.withColumn("content", printed)
    placed = running_before(rows, ["doc_id"], "page_idx", {
        "start": F.length("text"), "content_start": F.length("content") + len(sep)})
    chunks = placed.select(
        "doc_id", F.lit("pages").alias("chunk_group"), F.col("page_idx").alias("chunk_idx"),
        F.concat("doc_id", F.lit("/pages@"), F.col("page_idx").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("parent"), F.col("start").cast("int").alias("start"),
        F.length("text").alias("length"), "content", "metadata",
        *(["annotations"] if "annotations" in pages.columns else []),
        F.lit(1).alias("depth"), "content_start")
    whole = concat_ordered(rows, ["doc_id"], "page_idx", "content", sep)
    docs = whole.withColumn("reason", F.when(F.col("content").isNull(), F.lit("text_too_long")))
    return docs, as_chunks(chunks, extra=["content_start"])


# --- routing ----------------------------------------------------------------------

def needs_model(threshold: float = OCR_THRESHOLD, detect_boundaries: bool = False) -> Column:
    """Pages a vision model must see; the others never leave the JVM."""
    low = F.col("ocr_confidence") < threshold
    return low | (F.col("page_idx") > 0) if detect_boundaries else low


def vision_prompts(pages: DataFrame, description: str | None = None, intent: str | None = None,
                   graphic_instructions: str | None = None, tags: dict[str, str] | None = None,
                   describe: bool = True, preceding: bool = False) -> DataFrame:
    """User prompt of each page's transcription request.

    Optional columns ``preceding_content`` and ``preceding_context`` add context per page;
    ``preceding`` adds the image of the last page before that has one (by index).
    """
    def labelled(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))

    parts = [F.lit("Transcribe the page image into well-structured markdown, word for word, and decide "
                   "whether it starts a new document. Keep tables as markdown tables where possible.")]
    for label, value in (("Document description: ", description), ("Intended use: ", intent),
                         ("Instructions for graphics: ", graphic_instructions)):
        parts.append(labelled(label, F.lit(value).cast("string")))
    for label, name in (("Markdown of the preceding page:\n", "preceding_content"),
                        ("What precedes this page:\n", "preceding_context")):
        if name in pages.columns:
            parts.append(labelled(label, F.col(name)))
    if preceding:
        pages = last_before(pages, ["doc_id"], "page_idx",
                            F.when(F.col("image_url").isNotNull(), F.col("page_idx")), "preceding_idx")
        parts.append(F.when(F.col("preceding_idx").isNotNull(),
                            F.lit("The image of a preceding page is provided besides the current page.")))
    if tags:
        lines = "".join(f'- Tag "{k}": {v}\n' for k, v in tags.items())
        parts.append(F.lit(f"Tags to apply by their definitions:\n{lines}List those that fit under \"tags\"."))
    parts.append(F.lit("Add a \"description\" of one to three sentences." if describe else "No description needed."))
    parts.append(F.lit('Answer with raw JSON only: "markdown", "isFirstPage", optional "description", "tags".'))
    return pages.withColumn("user", F.concat_ws("\n\n", *parts))


def route_pages(pages: DataFrame, threshold: float = OCR_THRESHOLD, detect_boundaries: bool = False,
                model: str | None = None, describe: bool = True) -> DataFrame:
    """Settle each page from its OCR result and, where routed, its model reply.

    ``pages(doc_id, page_idx, ocr_text, ocr_confidence, vision_reply[, vision_error])``;
    replies are wanted only for ``needs_model`` rows. Adds text, method, confidence,
    model_name, is_first_page, description, tags.
    """
    low = F.col("ocr_confidence") < threshold
    rows = pages.withColumn("_r", F.when(F.col("vision_reply").isNotNull(),
                                         normalize_vision_reply(F.col("vision_reply"), describe)))
    used = low | F.lit(detect_boundaries)
    flag = (F.when(F.col("page_idx") == 0, True)
            .when(used, F.coalesce("_r.is_first_page", F.lit(False))).otherwise(False))
    text = F.when(low, F.coalesce(F.nullif(F.col("_r.markdown"), F.lit("")), F.lit(NO_OUTPUT))).otherwise(F.col("ocr_text"))
    seen = used & (low | (F.col("page_idx") > 0))
    out = rows.select(
        *pages.columns, text.alias("text"),
        F.when(low, "vision_model").otherwise("ocr").alias("method"),
        F.round(F.when(low, F.greatest("ocr_confidence", F.lit(VISION_CONFIDENCE))).otherwise(F.col("ocr_confidence")), 3)
        .alias("confidence"),
        F.when(low, F.lit(model)).cast("string").alias("model_name"), flag.alias("is_first_page"),
        F.when(seen, F.nullif(F.col("_r.description"), F.lit(""))).alias("description"),
        F.when(seen & (F.size("_r.tags") > 0), F.col("_r.tags")).alias("tags"))
    return out


def tag_by_substring(df: DataFrame, tags: dict[str, str], text: str = "text") -> DataFrame:
    """``tags``: names of all tags whose text occurs in the row, in the order given."""
    hits = F.array(*[F.when(F.contains(F.col(text), F.lit(needle)), F.lit(name)) for name, needle in tags.items()])
    return df.withColumn("tags", F.array_compact(hits))


# --- failures ----------------------------------------------------------------------

def failure_notice(name: Column, message: Column, model: Column, at: Column) -> Column:
    return F.concat(F.lit(NOTICE_HEAD), F.coalesce(name, F.lit("Unknown")),
                    F.lit("\n**Error Message:** "), message, F.lit("\n**Timestamp:** "), at,
                    F.lit("\n**Model:** "), F.coalesce(model, F.lit("Unknown")), F.lit(NOTICE_TAIL))


def error_pages(pages: DataFrame, model: str | None, at: str) -> DataFrame:
    """Placeholder pages for rows with ``vision_error``; ``at`` is the job's time stamp."""
    name, message = F.col("vision_error.name"), F.coalesce("vision_error.message", F.lit(""))
    filename = F.col("filename") if "filename" in pages.columns else F.lit("")
    meta = json_object(
        ("page_number", (F.col("page_idx") + 1).cast("string")), ("text_extraction_method", F.lit('"error_placeholder"')),
        ("extraction_confidence", F.lit("0")), ("model_name", F.coalesce(json_string(F.lit(model).cast("string")), F.lit("null"))),
        ("isFirstPage", (F.col("page_idx") == 0).cast("string")), ("originating_filename", json_string(filename)),
        ("originating_file_sha256", json_string(F.col("doc_id"))), ("transcription_failed", F.lit("true")),
        ("error_type", json_string(F.coalesce(name, F.lit("unknown")))), ("error_message", json_string(message)))
    return pages.select(
        "doc_id", "page_idx", failure_notice(name, message, F.lit(model).cast("string"), F.lit(at)).alias("text"),
        meta.alias("metadata"), F.lit(f'{{"description":"{NOTICE_DESCRIPTION}"}}').alias("annotations"))


def apply_failure_policy(pages: DataFrame, continue_on_failure: bool, model: str | None = None,
                         at: str = "", keep_good_pages: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages ready to assemble, one status row per document).

    With ``continue_on_failure`` a content-filtered page becomes a placeholder; any other
    page error replaces the document by one failure page (or, with ``keep_good_pages``,
    only that page). Without it a document with an error yields no pages, only the error.
    """
    failed = F.col("vision_error").isNotNull()
    filtered = F.coalesce(F.col("vision_error.interpreted_type") == "content_filter_violation", F.lit(False))
    fatal = failed & (~filtered if continue_on_failure and not keep_good_pages else F.lit(not continue_on_failure))
    # Partial aggregation: one small row per document leaves each task.
    per_doc = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_total"), F.count_if(failed).alias("_failed"),
        F.bool_or(fatal).alias("_fatal"),
        F.min_by("vision_error", F.when(fatal, F.col("page_idx"))).alias("_error"))
    status = per_doc.select(
        "doc_id", F.when(~F.col("_fatal"), F.when(F.col("_failed") > 0, "partial").otherwise("complete"))
        .when(F.lit(continue_on_failure), "failed").otherwise("error").alias("transcription_status"),
        F.when(F.col("_fatal"), F.col("pages_total")).otherwise(F.col("_failed")).alias("pages_failed"),
        F.when(F.col("_fatal"), F.lit(0)).otherwise(F.col("pages_total") - F.col("_failed")).alias("pages_successful"),
        F.when(F.col("_fatal"), F.col("_error.message")).alias("error_message"))
    lost = per_doc.where("_fatal").select("doc_id", F.col("_error").alias("vision_error"))
    alive = pages.join(lost.select("doc_id"), "doc_id", "left_anti")
    filename = F.col("filename") if "filename" in pages.columns else F.lit("")
    good = alive.where(~failed).select(
        "doc_id", "page_idx", "text",
        page_metadata(F.col("doc_id"), F.col("page_idx"), F.col("method"), F.col("confidence"), F.col("model_name"),
                      F.col("is_first_page"), filename, F.col("tags")).alias("metadata"),
        F.when(F.col("description").isNotNull(), json_object(("description", json_string(F.col("description")))))
        .alias("annotations"))
    ready = good.unionByName(error_pages(alive.where(failed), model, at))
    if continue_on_failure:
        ready = ready.unionByName(error_pages(lost.withColumn("page_idx", F.lit(0)), model, at))
    return ready, status


def page_failure_rollup(pages: DataFrame, failed: Column) -> DataFrame:
    """Failed and successful pages per document; ``partial`` where some failed."""
    return pages.groupBy("doc_id").agg(
        F.count_if(failed).alias("pages_failed"), F.count_if(~failed).alias("pages_successful")).withColumn(
        "transcription_status", F.when(F.col("pages_failed") > 0, "partial"))
