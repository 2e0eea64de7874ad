"""Files in and out, provider payloads, incremental runs."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docflow.operators import chunking as K
from docflow.operators import transcripts as T
from docflow.plans.render import RequestOptions, model_parameters, render_messages, render_requests
from docflow.schemas import as_chunks, as_docs
from docflow.sinks.documents import chunk_listing, nest_docs, write_docs
from docflow.sinks.transcripts import attachment_rows, write_attachments, write_batch_requests, write_transcripts
from docflow.sources.docjson import parse_docs, parse_embeddings, read_docs
from docflow.sources.files import decode_uploads, read_attachments, read_binary, read_text_files, wrap_documents
from docflow.sources.office import ingest_docx, ingest_pptx
from docflow.streaming.incremental import read_latest, run_incremental
from docflow.workload.inputs import lines

PNG = bytes.fromhex("89504e470d0a1a0a0000000d49484452")
DOC = {"id": "d", "content": "Hello \"world\"\n", "metadata": {"z": 1, "a": "x"}, "annotations": {"summary": ["a", {"delta": "b"}]}, "chunks": {
    "pages": [{"id": "d/pages@0", "parent": "d", "start": 0, "length": 5, "metadata": {"page_number": 1}},
              {"id": "d/pages@1", "parent": "d", "content": "", "chunks": {"lines": [{"id": "deep", "content": "x"}]}}],
    "notes": [{"id": "n0", "content": "note", "embeddings": {"m": [0.5, 1.0]}}]}}


def test_doc_json_round_trip(spark, tmp_path):
    flat = json.loads(json.dumps(DOC))
    del flat["chunks"]["pages"][1]["chunks"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(flat) + "\nbroken {\n[1]\n")
    docs, chunks, rejects = read_docs(spark, str(tmp_path / "in"))
    assert rejects.count() == 2 and docs.count() == 1 and chunks.count() == 3
    vectors = parse_embeddings(spark.createDataFrame([(json.dumps(flat),)], "json string"))
    out = json.loads(nest_docs(docs, chunks, vectors).first().json)
    for c in flat["chunks"]["notes"]:
        c["parent"] = "d"
    assert out == flat and list(out["metadata"]) == ["z", "a"]
    write_docs(docs, chunks, str(tmp_path / "out"), embeddings=vectors)
    again = read_docs(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, chunks.collect())) and again[0].first() == docs.first()


def test_nested_chunks(spark):
    docs, chunks, rejects = parse_docs(spark.createDataFrame([(json.dumps(DOC),)], "json string"))
    deep = chunks.where("chunk_id = 'deep'").first()
    assert (deep.depth, deep.parent, deep.doc_id, deep.content) == (2, "d/pages@1", "d", "x") and rejects.count() == 0
    assert docs.first().size_bytes == len(DOC["content"])


def test_listing_titles(spark):
    docs = as_docs(spark.createDataFrame([("a", '{"originating_filename":"f.pdf","filename":"g"}'), ("b", '{"filename":"g.md"}'), ("c", None)], "doc_id string, metadata string"))
    chunks = as_chunks(spark.createDataFrame([(d, "g", 0, "t") for d in "abc"], "doc_id string, chunk_group string, chunk_idx int, content string"))
    assert {r.title for r in chunk_listing(chunks, docs).collect()} == {"f.pdf (Part 1)", "g.md (Part 1)", "Document (Part 1)"}
    job = K.chunking_job(docs.withColumn("content", F.lit("one two three four")), chunks.limit(0), "merge_and_split", 3).where("doc_id = 'a'").orderBy("chunk_index")
    assert [json.loads(r.chunk_data) for r in job.collect()] == [{"title": "f.pdf (Part 1)", "body": "one two three"}, {"title": "f.pdf (Part 2)", "body": " four"}]


def test_text_files_and_attachments(spark, tmp_path):
    for name, data in {"a.txt": b"plain \xc3\xa9", "b.MD": b"# t", "c.exe": b"no", "d.doc.json": b"{}", "p.png": PNG, "q.csv": b"1,2"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "plain é", "b.MD": "# t"}
    parts = {r.path.rsplit("/", 1)[1]: r for r in read_attachments(spark, str(tmp_path)).collect()}
    assert parts["p.png"].part.url == "data:image/png;base64," + base64.b64encode(PNG).decode()
    assert parts["q.csv"].part.text == "1,2" and parts["q.csv"].part.filename == "q.csv" and parts["c.exe"].reason == "Unsupported file type: .exe"


def test_wrap_and_uploads(spark):
    df = spark.createDataFrame([(1, {"b": 1, "a": 2})], "id int, c struct<b:int,a:int>")
    assert wrap_documents(df, "c").first().content == '{"b":1,"a":2}'
    urls = ["data:application/pdf;base64," + base64.b64encode(b"%PDF").decode(), "data:text/plain;base64,AA==", None]
    rows = decode_uploads(spark.createDataFrame([(u,) for u in urls], "pdf_dataurl string")).collect()
    assert rows[0].content == b"%PDF" and rows[0].reason is None and all(r.content is None and r.reason for r in rows[1:])


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda *runs: "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"
    body = para("<w:t>First </w:t>", "<w:t>page</w:t>") + para('<w:br w:type="page"/>', "<w:t>Second</w:t>", "<w:tab/>", "<w:t>page</w:t>")
    (tmp_path / "f.docx").write_bytes(archive({"word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>"}))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    docs, chunks, rejects = ingest_docx(read_binary(spark, str(tmp_path)))
    rows = chunks.orderBy("chunk_idx").collect()
    assert [r.content.split("-->\n")[-1] for r in rows] == ["First page", "Second\tpage"] and [r.start for r in rows] == [0, 10]
    assert docs.first().content.count("<!-- page boundary -->") == 1 and rejects.first().path.endswith("bad.docx")
    assert json.loads(rows[1].metadata)["extraction_confidence"] == 1 and json.loads(rows[1].metadata)["model_name"] is None


def test_pptx(spark, tmp_path):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda kind, *texts: f'<p:sp><p:nvSpPr><p:cNvPr/><p:nvPr>{f"""<p:ph type="{kind}"/>""" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts) + "</p:txBody></p:sp>"
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>" + cell("h1") + cell("h2") + "</a:tr><a:tr>" + cell("v") + "</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    slide = lambda inner: f"<p:sld {ns}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    (tmp_path / "s.pptx").write_bytes(archive({"ppt/slides/slide10.xml": slide(shape("title", "Last")), "ppt/slides/slide2.xml": slide(
        shape("ctrTitle", "Title") + shape("subTitle", "Sub") + shape("body", "• one", "• two") + shape(None, "free") + table), "ppt/slides/slide11.xml": slide("")}))
    markdown, rejects = ingest_pptx(read_binary(spark, str(tmp_path)))
    assert markdown.first().markdown == (
        "<!-- SLIDE: 1 -->\n\n<!-- TYPE: title -->\n## Title\n\n<!-- TYPE: subtitle -->\n### Sub\n\n<!-- TYPE: body -->\n - one\n - two\n\n---\n\n"
        "<!-- TYPE: text -->\nfree\n\n---\n\n<!-- TYPE: table -->\n| h1 | h2 |\n| --- | --- |\n| v |  |\n\n---\n---\n\n"
        "<!-- SLIDE: 2 -->\n\n<!-- TYPE: title -->\n## Last\n\n---\n---\n\n<!-- SLIDE: 3 -->\n")
    assert rejects.count() == 0


TALK = {"messages": [
    {"role": "system", "content": "Sys"}, {"role": "user", "content": ["Look", {"type": "image", "url": "data:image/png;base64,QUJD"}, {"type": "document", "filename": "n.md", "content": "# n"}]},
    {"role": "tool_call", "content": [{"toolName": "calc", "callId": "c1", "callType": "function", "arguments": {"b": 2, "a": 1}, "rationale": None}]},
    {"role": "tool_response", "content": [{"toolName": "calc", "callId": "c1", "response": {"r": 3}}]}, {"role": "assistant", "content": "3"}]}


def talk(spark):
    return T.read_transcripts(spark.createDataFrame([("t", json.dumps(TALK))], "conv_id string, transcript string"))


def test_transcript_round_trip(spark, tmp_path):
    turns = talk(spark)
    assert json.loads(T.transcripts_json(turns).first().json) == TALK
    write_transcripts(turns, str(tmp_path / "t"))
    assert json.loads(spark.read.text(str(tmp_path / "t")).first().value) == {"conv_id": "t", **TALK}


def messages(spark, provider):
    rows = render_messages(talk(spark), provider).orderBy("turn").collect()
    return [json.loads(m) for r in rows for m in r.messages]


def test_provider_payloads(spark):
    openai = messages(spark, "openai")
    assert openai[0] == {"role": "system", "content": "Sys"} and openai[4] == {"role": "assistant", "content": "3"}
    assert openai[1]["content"] == [{"type": "text", "text": "Look"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,QUJD", "detail": "high"}}, {"type": "text", "text": "# n"}]
    call = openai[2]["tool_calls"][0]
    assert openai[2]["content"] is None and call["id"] == "c1" and json.loads(call["function"]["arguments"]) == {"a": 1, "b": 2}
    assert openai[3] == {"role": "tool", "tool_call_id": "c1", "content": '{"r":3}'}
    anthropic = messages(spark, "anthropic")
    assert anthropic[1]["content"][1] == {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "QUJD"}}
    assert anthropic[2] == {"role": "assistant", "content": [{"type": "text", "text": "<thinking>A tool is called.</thinking>"},
                                                             {"type": "tool_use", "id": "c1", "name": "calc", "input": {"a": 1, "b": 2}}]}
    assert anthropic[3] == {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": {"r": 3}}]}
    ollama = messages(spark, "ollama")
    assert ollama[1] == {"role": "user", "content": "Look\n# n", "images": ["data:image/png;base64,QUJD"]}
    assert ollama[2]["content"] == '[ToolCall: calc, arguments: {"a":1,"b":2}]' and ollama[3]["content"] == '[ToolResponse from calc: {"r":3}]'
    google = messages(spark, "google")
    assert [m["role"] for m in google] == ["user", "model"] and google[0]["parts"] == [{"text": "Look"}, {"inline_data": {"mime_type": "image/png", "data": "QUJD"}}]


def test_model_parameters(spark):
    show = lambda o: {k: spark.range(1).select(c.alias("x")).first().x for k, c in model_parameters(o).items()}
    assert show(RequestOptions("gpt-4o", temperature=0.0, max_output_tokens=5)) == {"temperature": "0", "stream": "false", "max_tokens": "5"}
    assert show(RequestOptions("o1-preview", temperature=1.0)) == {}
    assert show(RequestOptions("o3", temperature=1.0, max_output_tokens=5)) == {"reasoning_effort": '"high"'}
    assert show(RequestOptions("gpt-5", temperature=1.0, verbosity="low", reasoning_effort="low")) == {"reasoning_effort": '"low"', "verbosity": '"low"'}
    assert json.loads(show(RequestOptions("gpt-4o", schema={"type": "array"}))["response_format"])["json_schema"]["schema"]["required"] == ["result"]


def test_batch_request_files(spark, tmp_path):
    tools = ({"name": "calc", "description": "adds"},)
    write_batch_requests(talk(spark), {"openai": RequestOptions("gpt-4o", "S", tools=tools), "anthropic": RequestOptions("c", "S", 0.5)}, str(tmp_path / "b"))
    rows = {r.provider: json.loads(r.value) for r in spark.read.text(str(tmp_path / "b")).collect()}
    assert rows["openai"]["custom_id"] == "t" and rows["openai"]["body"]["messages"][0] == {"role": "developer", "content": "S"}
    assert rows["openai"]["body"]["tools"][0]["function"]["name"] == "calc"
    assert rows["anthropic"]["body"]["max_tokens"] == 4096 and rows["anthropic"]["body"]["system"] == "S"
    body = render_requests(talk(spark).where("role = 'system'"), "google", RequestOptions("g", "S")).first().body
    assert json.loads(body) == {"model": "g", "contents": [], "generationConfig": {}, "systemInstruction": {"parts": [{"text": "S"}]}}


def test_attachment_rows(spark, tmp_path):
    rows = attachment_rows(talk(spark)).orderBy("pos").collect()
    assert [(r.kind, r.mime, bytes(r.content)) for r in rows] == [("image", "image/png", b"ABC"), ("document", None, b"# n")]
    write_attachments(talk(spark), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_incremental_equals_batch(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) doc_id", "text")
    split = lambda df: as_chunks(df.select("doc_id", F.lit("lines").alias("chunk_group"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "content")))
    job = lambda df: K.merge_chunks(split(df), 100, "lines")
    for part in (0, 1):
        docs.where(F.col("doc_id").cast("int") % 2 == part).write.mode("append").parquet(source)
        run_incremental(spark, source, "doc_id string, text string", job, out, ckpt)
    # One document is submitted again with another text.
    docs.where("doc_id = '3'").withColumn("text", F.lit("short")).write.mode("append").parquet(source)
    run_incremental(spark, source, "doc_id string, text string", job, out, ckpt)
    got = {(r.doc_id, r.chunk_idx, r.content) for r in read_latest(spark, out).collect()}
    want = {(r.doc_id, r.chunk_idx, r.content) for r in job(docs.where("doc_id <> '3'")).collect()}
    assert got == want | {("3", 0, "short")}
    assert lines(spark, "/root/testdata/sf0.001").count() > 0


def test_status_of_three_drops_equals_one_batch(spark, tmp_path):
    """Counts go on from the checkpoint's state, also in a run that is started anew; only new rows are read."""
    from docflow.operators.jobs import job_progress
    from docflow.streaming.status import read_status, run_status
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows = spark.range(900).select((F.col("id") % 7).alias("job_id"), F.when(F.col("id") % 90 == 5, "error").when(F.col("id") > 800, "pending").otherwise("done").alias("state"), "id")
    for part in range(3):
        rows.where(F.col("id") % 3 == part).drop("id").write.mode("append").parquet(source)
        query = run_status(spark, source, "job_id bigint, state string", lambda df: df, out, ckpt)
        assert query.lastProgress.numInputRows == 300 and query.lastProgress.stateOperators[0].numRowsTotal == 7
        so_far = rows.where(F.col("id") % 3 <= part)
        assert sorted(map(tuple, read_status(spark, out).collect())) == sorted(map(tuple, job_progress(so_far).collect()))


def test_files_of_failed_attempts_are_gone(spark, tmp_path):
    from docflow.sinks.files import write_files
    folder = tmp_path / "out"
    rows = spark.createDataFrame([("a/one.txt", b"1"), ("two.bin", b"\x00\xff"), ("empty", None)], "name string, content binary")
    write_files(rows, str(folder))
    write_files(rows.where("name = 'two.bin'").select("name", F.lit(b"new").alias("content")), str(folder))
    found = {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert found == {"a/one.txt": b"1", "two.bin": b"new", "empty": b""}
    bad = spark.createDataFrame([("x.txt", b"1"), ("../y.txt", b"2")], "name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        write_files(bad, str(folder))
    assert not (folder / "x.txt").exists() and not (folder / "_work").exists() and not (tmp_path / "y.txt").exists()


def test_tasks_list_the_files_that_spark_lists(spark, tmp_path):
    files = {"top.txt": b"1", "a/b/c/deep.bin": bytes(300), "a/x y%20z.txt": b"2", "a/z.txt.gz": b"not packed", "k=v/_c=d": b"3", "é/ü.txt": b"4", "_metadata/in.txt": b"5",
             "empty.txt": b"", ".hidden": b"h", "_work/in.txt": b"h", "a/.dot/in.txt": b"h", "a/_SUCCESS": b"h", "_metadata/_metadata": b"h", "a/f._COPYING_": b"h"}
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "none").mkdir()
    folder = str(tmp_path / "in")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content", "length")
    want = sorted((r.path, bytes(r.content), r.length) for r in listed.collect())
    assert [c for _, c, _ in want] and sum(c != b"h" for _, c, _ in want) == len(want) == 7
    for path in (folder, f"{folder}/", f"file:{folder}", f"file://{folder}", f"{tmp_path}/./none/..//in"):
        got = read_binary(spark, path)
        assert got.dtypes == listed.dtypes and sorted((r.path, bytes(r.content), r.length) for r in got.collect()) == want
    assert {r.path for r in read_text_files(spark, folder).collect()} == {p for p, _, _ in want if p.endswith(".txt")}
    assert read_binary(spark, str(tmp_path / "none")).count() == 0
    for path in (f"{folder}/top.txt", f"{folder}/*.txt", f"{folder}/{{top}}.txt"):
        assert [bytes(r.content) for r in read_binary(spark, path).collect()] == [b"1"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_binary(spark, str(tmp_path / "missing")).count()


def test_many_files_take_no_more_tasks(spark, tmp_path):
    """What comes to the driver does not grow with the number of files and folders; see F6 of round 3."""
    def tasks(n):
        for k in range(n):
            (tmp_path / f"{n}/{k}").mkdir(parents=True)
            (tmp_path / f"{n}/{k}/0-1-note.md").write_text(f"note {k}")
        sc = spark.sparkContext
        sc.setJobGroup(f"read {tmp_path}/{n}", "")
        try:
            assert {r.part.text for r in read_attachments(spark, str(tmp_path / str(n))).collect()} == {f"note {k}" for k in range(n)}
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(f"read {tmp_path}/{n}") for s in tracker.getJobInfo(j).stageIds}
        return sum(tracker.getStageInfo(s).numTasks for s in stages)

    few, many = tasks(10), tasks(400)
    assert 0 < many == few
