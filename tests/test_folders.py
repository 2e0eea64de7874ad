"""Tables that are folders of several files, as larger ones are."""

from docflow.workload import QUERIES


def test_streams_over_folders(spark, tmp_path):
    spark.createDataFrame([(i, f"line {i}\nmore", "en") for i in range(20)], "doc_id bigint, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i % 4, t) for i, t in enumerate(("view", "error", "click") * 5)], "user_id bigint, event_type string").repartition(3).write.parquet(
        str(tmp_path / "events.parquet"))
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert rows("incremental_merge") == rows("merge_chunks_200") and len(rows("incremental_merge")) == 20
    assert rows("job_status_stream") == rows("job_progress") and rows("job_progress")


def test_spans_leave_their_segment_behind(spark, tmp_path):
    """Many spans of one long text: what is grouped are the pieces, not a segment for each of them."""
    from pyspark.sql import functions as F

    from docflow.operators.rope import cut_spans, rope_of_cells

    texts = spark.createDataFrame([(1, "ab" * 30)], "k int, text string")
    spans = spark.range(6).select(F.col("id").alias("n"), F.lit(1).alias("k"), (F.col("id") * 5).cast("int").alias("start"), F.lit(4).alias("length"))
    cut = cut_spans(rope_of_cells(texts, "k", segment=7), spans, ["n"], "k", segment=7)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate"):].split("\n")[1]
    assert "Project" in grouped and "AS t#" in grouped
    assert {r.n: r.text for r in cut.collect()} == {n: ("ab" * 30)[n * 5:n * 5 + 4] for n in range(6)}


def test_levels_read_their_own_texts_only(spark, monkeypatch):
    """A level of a tree is put together from the texts of the level below, without reading those under it again."""
    from docflow.operators import content as C

    tree = [("D", None, None, 0, None, "parts"), *[(f"D/{i}", "D", "parts", i, None, "lines") for i in range(2)],
            *[(f"D/{i}/{j}", f"D/{i}", "lines", j, f"{i}{j} ", None) for i in range(2) for j in range(3)]]
    nodes = spark.createDataFrame([(n, p, g, i, c, None, None, cg) for n, p, g, i, c, cg in tree],
                                  "node_id string, parent_id string, chunk_group string, idx int, content string, start int, length int, content_chunk_group string")
    read, concat = [], C.concat_ordered
    monkeypatch.setattr(C, "concat_ordered", lambda df, *a, **k: (read.append([f for f in df.inputFiles() if "/nodes/" in f]), concat(df, *a, **k))[1])
    texts, rejects = C.resolve_nested(nodes)
    assert {r.node_id: r.text for r in texts.collect()}["D"] == "00 01 02 10 11 12 " and rejects.isEmpty()
    assert len(read) == 2 and read[0] and not read[1]
