"""Pages with failures, error JSON, limits, jobs."""

import json

import pytest
from pyspark.sql import functions as F

from docflow.functions.errors import classify_errors, error_column, errors_from_json, errors_to_json, http_status, retry_plan
from docflow.functions.schema_check import unwrap_reply
from docflow.operators import convert as V
from docflow.operators.jobs import job_progress, job_results, merge_total
from docflow.operators.policy import LIMITS, resolve_alias, resolve_policy
from docflow.schemas import ERROR

PAGES = ("doc_id string, page_idx int, ocr_text string, ocr_confidence double, vision_reply string, "
         "vision_error struct<name:string,message:string,interpreted_type:string>, filename string")


def pages(spark, kind="content_filter_violation"):
    ok = lambda n: json.dumps({"markdown": f"transcribed:mock-page-{n}.png", "isFirstPage": False})
    error = ("Error", "image blocked by content safety", kind)
    return spark.createDataFrame([("sha", 0, "ignored", 0.05, ok(1), None, "fixture.pdf"), ("sha", 1, "ignored", 0.05, None, error, "fixture.pdf"),
                                  ("sha", 2, "ignored", 0.05, ok(3), None, "fixture.pdf")], PAGES)


def convert(df, **kw):
    ready, status = V.apply_failure_policy(V.route_pages(df, model="m"), model="m", at="2024-01-01T00:00:00.000Z", **kw)
    docs, chunks = V.assemble_pages(ready)
    return status.first(), docs.collect(), chunks.orderBy("chunk_idx").collect()


def test_continue_on_filtered_page(spark):
    status, docs, chunks = convert(pages(spark), continue_on_failure=True)
    assert (status.transcription_status, status.pages_failed, status.pages_successful) == ("partial", 1, 2)
    meta = [json.loads(c.metadata) for c in chunks]
    assert [m["page_number"] for m in meta] == [1, 2, 3]
    assert [m["text_extraction_method"] for m in meta] == ["vision_model", "error_placeholder", "vision_model"]
    assert meta[1]["transcription_failed"] is True and meta[1]["error_message"] == "image blocked by content safety"
    assert "transcription_failed" not in meta[0] and meta[0]["extraction_confidence"] == 0.9 and meta[0]["isFirstPage"] is True
    assert chunks[0].annotations is None and "Transcription Failed" in chunks[1].content
    text = docs[0].content
    assert 0 <= text.index("transcribed:mock-page-1.png") < text.index("Transcription Failed") < text.index("transcribed:mock-page-3.png")
    assert "<!-- METADATA page_number: 1 -->\n<!-- METADATA text_extraction_method: vision_model -->" in text and "<!-- METADATA model_name: m -->" in text
    for c in chunks:
        assert text[c.content_start:c.content_start + len(c.content)] == c.content
    assert [c.chunk_id for c in chunks] == ["sha/pages@0", "sha/pages@1", "sha/pages@2"] and chunks[1].start == len("transcribed:mock-page-1.png")


def test_other_errors_fail_the_document(spark):
    status, docs, chunks = convert(pages(spark, "rate_limit"), continue_on_failure=True)
    assert (status.transcription_status, status.pages_failed, status.pages_successful) == ("failed", 3, 0)
    assert len(chunks) == 1 and "Transcription Failed" in docs[0].content
    status, docs, chunks = convert(pages(spark, "rate_limit"), continue_on_failure=True, keep_good_pages=True)
    assert status.transcription_status == "partial" and len(chunks) == 3
    status, docs, chunks = convert(pages(spark), continue_on_failure=False)
    assert status.transcription_status == "error" and status.error_message == "image blocked by content safety" and chunks == []


def test_only_routed_pages_reach_the_model(spark):
    df = pages(spark).withColumn("ocr_confidence", F.when(F.col("page_idx") == 1, 0.05).otherwise(0.95))
    assert [r.page_idx for r in df.where(V.needs_model()).collect()] == [1]
    assert [r.page_idx for r in df.where(V.needs_model(detect_boundaries=True)).orderBy("page_idx").collect()] == [1, 2]


def test_error_json(spark):
    rows = spark.createDataFrame([(400, "content_filter", "image blocked by content safety")], "status int, code string, message string")
    out = error_column(classify_errors(rows), "openai").select(errors_to_json(F.col("error")).alias("j")).first().j
    assert set(json.loads(out)) == {"exception", "provider", "message", "interpretedErrorType", "interpretedCode", "interpretedMessage"}
    df = spark.createDataFrame([(out,), ('"Error: plain failure"',), ('{"provider":7}',), ("[]",)], "j string")
    got = df.select(errors_from_json(F.col("j")).alias("e"), http_status(F.col("j")).alias("s")).collect()
    assert got[0].e.interpreted_type == "content_filter_violation" and got[0].s == 422
    assert [g.e for g in got[1:]] == [None] * 3 and [g.s for g in got[1:]] == [500] * 3
    plain = spark.range(1).select(F.from_json(F.lit('{"message":"plain failure","name":"Error"}'), ERROR).alias("e"))
    assert plain.select(errors_to_json(F.col("e")).alias("j")).first().j == '"Error: plain failure"'


def test_retry_plan(spark):
    rows = [("a", 1, False, 503, False), ("b", 1, False, 404, False), ("c", 1, False, None, True), ("d", 1, False, None, None), ("e", 1, False, 429, False), ("e", 2, True, None, False),
            ("f", 1, False, 500, False), ("f", 2, False, 500, False)]
    df = spark.createDataFrame(rows, "request_id string, attempt int, ok boolean, status int, aborted boolean")
    assert {tuple(r) for r in retry_plan(df).collect()} == {("a", 2, 250), ("d", 2, 250)}
    assert {tuple(r) for r in retry_plan(df, 9).collect()} == {("a", 2, 250), ("d", 2, 250), ("f", 3, 500)}


OVERRIDES = {"num_schema_repair_max_attempts": (5, 15, 25, 35), "num_defective_reply_max_attempts": (5, 15, 25, 35),
             "num_client_request_max_attempts": (2, 12, 22, 32), "ms_client_request_timeout": (600000, 610001, 620001, 630001)}


@pytest.mark.parametrize("key", LIMITS)
def test_policy_matrix(spark, key):
    default, model, general, request = OVERRIDES[key]
    ask = lambda given, models, settings: resolve_policy(spark.createDataFrame([("m", given)], f"model string, {key} bigint"), models, settings).first()[key]
    other = {"m": {}, "x": {key: model}}
    assert ask(None, other, {}) == default
    assert ask(None, {"m": {key: model}}, {}) == model
    assert ask(None, other, {key: general}) == general
    assert ask(None, {"m": {key: model}}, {key: general}) == model
    assert ask(request, {"m": {key: model}}, {key: general}) == request


def test_aliases(spark):
    models = {"a": "b", "b": "c", "c": {}, "x": "y", "y": "x", "dead": "gone"}
    assert resolve_alias(models, "a") == ("c", None)
    assert resolve_alias(models, "x")[1] == "Circular model alias detected: x -> y -> x"
    df = spark.createDataFrame([("a",), ("dead",), ("nope",)], "model string")
    got = {r.model: (r.resolved_model, r.model_error) for r in resolve_policy(df, models).collect()}
    assert got["a"] == ("c", None) and got["dead"][1] and got["nope"] == (None, "Model nope not found in config.")
    with pytest.raises(ValueError):
        resolve_policy(df, {"a": {"ms_client_request_timeout": 0}})


def test_jobs(spark):
    rows = [("p", 0, "pending", None), ("r", 0, "done", None), ("r", 1, "pending", None), ("e", 1, "error", "second"), ("e", 0, "error", "first"), ("c", 0, "done", None)]
    df = spark.createDataFrame(rows, "job_id string, chunk_idx int, state string, error string")
    got = {r.job_id: (r.total, r.completed, r.percent, r.status) for r in job_progress(df).collect()}
    assert got == {"p": (1, 0, 0, "pending"), "r": (2, 1, 50, "processing"), "e": (2, 0, 0, "error"), "c": (1, 1, 100, "complete")}
    assert [tuple(r) for r in job_results(df).collect()] == [("e", "first")] and merge_total(5) == 9 and merge_total(0) == 0


def test_unwrap(spark):
    cases = {'{"result":[1,2]}': "[1,2]", '{"result":"s"}': '"s"', '{"result":null}': "null", '{"x":1}': '{"x":1}', "no": "no"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", unwrap_reply(F.col("t"), True).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases
