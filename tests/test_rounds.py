"""Serial runs and tool rounds: what is read and written in each round."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from docflow.operators.tools import ToolRegistry, calculator_tool
from docflow.operators.transcripts import text_turns
from docflow.plans import extend
from docflow.plans import summarize as S
from docflow.plans.models import BatchModel, digest_model
from docflow.schemas import as_chunks
from docflow.workload.replies import _counting_model
from models import digest_call, open_none


def places(rows, size):
    return rows.withColumn("_seg", F.floor(F.col("chunk_idx") / size).cast("int"))


def test_a_round_reads_its_segment_only(spark):
    rows = places(spark.range(400).select((F.col("id") % 3).cast("string").alias("doc_id"), F.floor(F.col("id") / 3).cast("int").alias("chunk_idx"),
                                          F.lit("t").alias("text")), 16)
    store = S.SegmentStore(rows, "_seg", rows, "_seg")
    # Each segment has a folder, and a round's scan is pruned to it.
    for r in range(9):
        segment = store.segment(r)
        segment.collect()
        scan = segment._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numFiles").value() == len(glob.glob(f"{store.folder.removeprefix('file:')}/rows/_seg={r}/*.parquet")) > 0
    assert sum(store.segment(r).count() for r in range(9)) == 400 and not store.gaps
    going = store.advance(rows.where("_seg = 0").select("doc_id").distinct().withColumn("acc", F.lit("a")), 0, ["acc"])
    assert sorted(map(tuple, going.collect())) == [("0", "a"), ("1", "a"), ("2", "a")]


@pytest.mark.parametrize("gap", [False, True])
def test_segments_and_batches_agree(spark, gap):
    ids = [(d, i) for d, n in (("a", 1), ("b", 4), ("c", 9)) for i in range(n) if not (gap and (d, i) in {("c", 4), ("c", 5), ("b", 0), ("b", 1)})]
    rows = spark.createDataFrame([(d, "g", i, f"{d}/g@{i}", f"text {d} {i}") for d, i in ids],
                                 "doc_id string, chunk_group string, chunk_idx int, chunk_id string, content string")
    chunks = as_chunks(rows)
    model = BatchModel("digest", open_none, digest_call)
    shown = lambda df: sorted((r.doc_id, r.summary) for r in df.collect())
    one = shown(S.summarize_fold(chunks, digest_model(), "g"))
    assert one == shown(S.summarize_fold(chunks, digest_model(), "g", segment=2)) == shown(S.summarize_fold(chunks, model, "g", segment=3))
    whole, parts = (S.summarize_delta_fold(chunks, digest_model(), "g", segment=n) for n in (256, 2))
    assert shown(whole[0]) == shown(parts[0]) and sorted(map(tuple, whole[1].collect())) == sorted(map(tuple, parts[1].collect()))
    texts = chunks.select("doc_id", "chunk_idx", F.col("content").alias("summary"))
    assert shown(S.merge_left_to_right(texts, digest_model())) == shown(S.merge_left_to_right(texts, digest_model(), segment=2)) == shown(
        S.merge_left_to_right(texts, model))


def test_tool_rounds_write_new_turns_only(spark, monkeypatch):
    folders = []
    made = extend.work_folder
    monkeypatch.setattr(extend, "work_folder", lambda s: folders.append(made(s)) or folders[-1])
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * 50) for c in range(4) for t in range(2 * c + 1)]
    turns = text_turns(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    suffix, errors = extend.extend_transcripts(turns, _counting_model(), tools=ToolRegistry([calculator_tool()]))
    rows = suffix.collect()
    # c + 1 user messages: as many calls and results, and a reply.
    assert errors.count() == 0 and len(rows) == sum(2 * (c + 1) + 1 for c in range(4))
    log = spark.read.parquet(f"{folders[0]}/turns")
    assert log.count() == len(rows) and log.where("role = 'assistant'").count() == 4
