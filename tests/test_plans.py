"""Models in rounds: retry, repair, serial and tree summaries, tools."""

import json
import random

import pytest
from pyspark.sql import functions as F

import models as M
from docflow.functions.schema_check import find_violations, recursive_refs, variant_violations, violations, wrap_schema
from docflow.operators import transcripts as T
from docflow.operators.tools import ToolRegistry, ToolSpec, calculator_tool, echo_tool, execute_tool_calls
from docflow.plans import summarize as S
from docflow.plans.embed import embed_chunks, embed_texts
from docflow.plans.extend import extend_transcripts
from docflow.plans.models import BatchModel, ColumnModel, complete, complete_distinct, digest_model
from docflow.plans.structured import complete_structured, complete_with_retry
from docflow.schemas import as_chunks, as_docs
from docflow.workload.summaries import bracket_model, budget_model

SCHEMA = {"type": "object", "properties": {"name": {"type": "string"}, "status": {"type": "string", "enum": ["known", "unknown"]}},
          "required": ["name", "status"], "additionalProperties": False}


def batch(call, **kw):
    return BatchModel("m", M.open_none, call, **kw)


def requests(spark, *users):
    return spark.createDataFrame([(i, "sys", u) for i, u in enumerate(users)], "id int, system string, user string")


def corpus(spark, sizes=(0, 1, 2, 5, 9)):
    rows = [(f"d{n}", i, f"text {i} of {n}") for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_idx int, content string").withColumn("chunk_group", F.lit("g"))
    return as_chunks(df.withColumn("chunk_id", F.concat("doc_id", F.lit("/g@"), F.col("chunk_idx").cast("string"))))


def test_errors_are_rows(spark):
    rows = {r.id: r for r in complete(requests(spark, "good", "bad"), batch(M.failing_call)).collect()}
    assert rows[0].reply == "fine" and rows[0].error is None
    assert rows[1].reply is None and rows[1].error.interpreted_type == "content_filter_violation" and rows[1].error.status == 400


@pytest.mark.parametrize("limit,ok", [(1, False), (2, True)])
def test_defective_replies(spark, limit, ok):
    row = complete_with_retry(requests(spark, "x"), batch(M.flaky_call), limit).first()
    assert (row.error is None) == ok
    if ok:
        assert row.reply == "ok after 2"
    else:
        assert row.error.message.startswith("Exhausted num_defective_reply_max_attempts") and row.error.interpreted_code == 500


def test_repair(spark):
    rows = {r.user: r for r in complete_structured(requests(spark, "fix", "never"), batch(M.repair_call), SCHEMA, max_repairs=1).collect()}
    assert rows["fix"].error is None and json.loads(rows["fix"].reply) == {"name": "Alice", "status": "unknown"} and rows["fix"].repairs == 1
    error = rows["never"].error
    assert (error.interpreted_type, error.interpreted_code) == ("schema_validation_failed", 422)


def test_repair_exhausted_details(spark):
    schema = {"type": "object", "properties": {"summary": {"type": "string"}}, "required": ["summary"]}
    row = complete_structured(requests(spark, "x"), batch(M.empty_object_call), schema, max_repairs=1).first()
    assert json.loads(row.error.details) == {"mostValidOutput": {}, "finalResponse": "{}"}
    row = complete_structured(requests(spark, "x"), batch(M.empty_object_call), schema, max_repairs=0).first()
    assert json.loads(row.error.details) == {"mostValidOutput": None, "finalResponse": "{}"}


def check(spark, value, schema, first_only=False):
    df = spark.createDataFrame([(json.dumps(value),)], "t string")
    return [(v.instance_path, v.keyword) for v in df.select(variant_violations(F.parse_json("t"), schema, first_only).alias("v")).first().v]


def test_schema_keywords_over_keys_and_items(spark):
    found = lambda text, schema: check(spark, json.loads(text), schema)
    pattern = {"patternProperties": {"^n_": {"type": "number"}, "_s$": {"type": "string"}}, "properties": {"id": {"type": "integer"}}, "additionalProperties": False}
    assert found('{"n_a": 1, "b_s": "x", "id": 2}', pattern) == []
    assert sorted(found('{"n_a": "1", "b_s": 2, "zz": 0}', pattern)) == [("", "additionalProperties"), ("/b_s", "type"), ("/n_a", "type")]
    assert found('{"n_a_s": 1}', pattern) == [("/n_a_s", "type")]
    contains = {"contains": {"type": "number", "minimum": 5}, "maxContains": 2}
    assert [found(t, contains) for t in ("[1, 7]", "[1]", "[5, 6, 7]", '"no list"')] == [[], [("", "contains")], [("", "contains")], []]
    assert found("[]", {"contains": True}) == [("", "contains")] and found("[]", {"contains": {"type": "null"}, "minContains": 0}) == []
    branch = {"if": {"properties": {"k": {"const": "a"}}, "required": ["k"]}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}
    assert found('{"k": "a", "x": 1}', branch) == [] and sorted(found('{"k": "a"}', branch)) == [("", "if"), ("", "required")]
    assert found('{"k": "b", "y": 1}', branch) == [] and sorted(found("{}", branch)) == [("", "if"), ("", "required")]
    needs = {"dependentRequired": {"card": ["name", "zip"]}}
    assert found('{"card": 1, "name": 2}', needs) == [("", "dependentRequired")] and found('{"name": 2}', needs) == []


def _conforms(v, schema, root) -> bool:
    """A plain recursive check of the few keywords used below."""
    if "$ref" in schema and not _conforms(v, root["$defs"][schema["$ref"].rsplit("/", 1)[1]], root):
        return False
    kinds = {"object": dict, "array": list, "string": str, "null": type(None), "number": (int, float)}
    if "type" in schema and not isinstance(v, kinds[schema["type"]]):
        return False
    if "anyOf" in schema and not any(_conforms(v, x, root) for x in schema["anyOf"]):
        return False
    if isinstance(v, dict):
        return all(k in v for k in schema.get("required", [])) and all(_conforms(v[k], x, root) for k, x in schema.get("properties", {}).items() if k in v)
    return not isinstance(v, list) or all(_conforms(x, schema.get("items", {}), root) for x in v)


def test_recursive_schemas(spark):
    schema = {"$ref": "#/$defs/node", "$defs": {
        "node": {"type": "object", "required": ["id"], "properties": {
            "id": {"type": "number"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}},
            "twin": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/node"}]}}}}}
    assert recursive_refs(schema) == {"#/$defs/node"} and recursive_refs({"$ref": "#/$defs/a", "$defs": {"a": {"type": "null"}}}) == frozenset()
    rng = random.Random(6)

    def node(depth):
        out = {"id": rng.choice([*range(30), "x"])} if rng.random() > 0.02 else {}
        if depth and rng.random() < 0.6:
            out["kids"] = [node(depth - 1) for _ in range(rng.randint(0, 3))]
        if depth and rng.random() < 0.5:
            out["twin"] = rng.choice([None, node(depth - 1)])
        return out

    values = [node(5) for _ in range(60)] + [7, {"id": 1, "kids": [{"id": 1, "kids": [{"id": 2, "kids": [{"id": "bad"}]}]}]}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, "{broken")], "k int, reply string")
    found = {}
    for r in find_violations(rows, schema, "k").collect():
        found.setdefault(r.k, []).append((r.instance_path, r.keyword))
    assert found.pop(99) == [("", "parse")]
    assert set(found) == {i for i, v in enumerate(values) if not _conforms(v, schema, schema)} and 5 < len(found) < 55
    assert found[60] == [("", "type")] and found[61] == [("/kids/0/kids/0/kids/0/id", "type")]
    flat = {"type": "object", "required": ["a"]}
    assert [tuple(r) for r in find_violations(spark.createDataFrame([(1, "{}")], "k int, reply string"), flat, "k").select("k", "keyword").collect()] == [(1, "required")]


@pytest.mark.parametrize("value,schema,want", [
    (1.0, {"type": "integer"}, []), (1.5, {"type": "integer"}, [("", "type")]), (None, {"type": ["string", "null"]}, []),
    ("abc", {"minLength": 4, "pattern": "^a"}, [("", "minLength")]), ([1, "x", 3], {"items": {"type": "number"}}, [("/1", "type")]),
    ([1, 1], {"uniqueItems": True, "maxItems": 1}, [("", "maxItems"), ("", "uniqueItems")]),
    ({"a": 1, "b": "x"}, {"additionalProperties": {"type": "integer"}}, [("/b", "type")]),
    ({"a": {"b": [{}]}}, {"properties": {"a": {"properties": {"b": {"items": {"required": ["c"]}}}}}}, [("/a/b/0", "required")]),
    (5, {"anyOf": [{"type": "string"}, {"minimum": 6}]}, [("", "anyOf")]), (5, {"oneOf": [{"type": "integer"}, {"minimum": 1}]}, [("", "oneOf")]),
    (5, {"not": {"const": 5}}, [("", "not")]), (5, {"allOf": [{"maximum": 4}, {"exclusiveMinimum": 5}]}, [("", "maximum"), ("", "exclusiveMinimum")]),
    ({"a": [1]}, {"enum": [{"a": [1]}]}, []), (7, {"multipleOf": 3.5}, []), ({"x": 1}, {"$ref": "#/$defs/p", "$defs": {"p": {"required": ["y"]}}}, [("", "required")]),
    ({}, True, []), ({"a": 1}, {"properties": {"a": False}}, [("/a", "false schema")]), ({}, {"minProperties": 1}, [("", "minProperties")]),
])
def test_schema_keywords(spark, value, schema, want):
    assert check(spark, value, schema) == want


def test_schema_first_only_and_build_errors(spark):
    assert check(spark, {"name": 123, "status": "bad"}, SCHEMA, first_only=True) == [("/name", "type")]
    for bad in ({"dependentSchemas": {}}, {"type": "text"}, {"properties": {"a": {"propertyNames": {}}}}, {"$ref": "#"}):
        with pytest.raises(ValueError):
            violations(F.lit("{}"), bad)
    assert wrap_schema({"type": "array"})[1] and not wrap_schema({"type": "object"})[1]


def test_serial_methods_agree(spark):
    """Rounds with a Python model, segments with a column model, and one segment give one result."""
    chunks = corpus(spark)
    key = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
    digest, column = batch(M.digest_call), digest_model()
    fold = [key(S.summarize_fold(chunks, m, "g", before=1, segment=s), "doc_id", "summary") for m, s in ((column, 512), (column, 2), (digest, 512))]
    assert fold[0] == fold[1] == fold[2] and len(fold[0]) == 4
    delta = []
    for m, s in ((column, 512), (column, 2), (digest, 512)):
        whole, parts = S.summarize_delta_fold(chunks, m, "g", segment=s)
        delta.append((key(whole, "doc_id", "summary"), key(parts, "doc_id", "chunk_idx", "delta")))
    assert delta[0] == delta[1] == delta[2] and len(delta[0][1]) == 17
    cols = ("doc_id", "chunk_idx", "summary", "tokens_target", "tokens_actual", "budget_remaining")
    budget = [key(S.summarize_map_budget(chunks, m, "g", 12, segment=s), *cols) for m, s in ((budget_model(), 512), (budget_model(), 2), (batch(M.budget_call), 512))]
    assert budget[0] == budget[1] == budget[2] and len(budget[0]) == 17
    parts = chunks.select("doc_id", "chunk_idx", F.col("chunk_idx").cast("string").alias("summary"))
    ltr = [key(S.merge_left_to_right(parts, m, segment=s), "doc_id", "summary") for m, s in ((bracket_model(), 512), (bracket_model(), 2), (batch(M.bracket_call), 512))]
    assert ltr[0] == ltr[1] == ltr[2] and ("d5", "((((0+1)+2)+3)+4)") in ltr[0]


def halves(items):
    if len(items) == 1:
        return items[0]
    mid = len(items) // 2
    return f"({halves(items[:mid])}+{halves(items[mid:])})"


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_tree_shape(spark, monkeypatch, levels):
    monkeypatch.setattr(S, "TREE_LEVELS", levels)
    sizes = (1, 2, 3, 7, 8, 21, 100)
    parts = corpus(spark, sizes).select("doc_id", "chunk_idx", F.col("chunk_idx").cast("string").alias("summary"))
    got = {r.doc_id: r.summary for r in S.merge_tree(parts, bracket_model()).collect()}
    assert got == {f"d{n}": halves([str(i) for i in range(n)]) for n in sizes}


def test_tree_with_python_model(spark):
    parts = corpus(spark, (1, 3, 6)).select("doc_id", "chunk_idx", F.col("chunk_idx").cast("string").alias("summary"))
    got = {r.doc_id: r.summary for r in S.merge_tree(parts, batch(M.bracket_call)).collect()}
    assert got == {f"d{n}": halves([str(i) for i in range(n)]) for n in (1, 3, 6)}


@pytest.mark.parametrize("merge", [S.merge_left_to_right, S.merge_tree])
def test_failed_merges_keep_their_parts(spark, merge):
    """A failed document has an error and all its texts; others are not touched."""
    rows = [("ok", i, f"{i}") for i in range(5)] + [("no", i, "bad" if i == 2 else f"{i}") for i in range(5)] + [("one", 0, "bad")]
    parts = spark.createDataFrame(rows, "doc_id string, chunk_idx int, summary string")
    got = {r.doc_id: r for r in merge(parts, batch(M.refusing_bracket_call)).collect()}
    assert got["ok"].error is None and got["ok"].unmerged is None and got["ok"].summary.count("+") == 4
    assert got["no"].summary is None and got["no"].error.message == "blocked"
    kept = "".join(got["no"].unmerged)
    assert [c for c in kept.replace("bad", "2") if c.isdigit()] == list("01234") and "bad" in got["no"].unmerged
    assert (got["one"].summary, got["one"].error) == ("bad", None)


def test_summarize_returns_errors(spark):
    chunks = corpus(spark, (2, 3)).withColumn("content", F.when(F.col("chunk_id") == "d3/g@1", "bad").otherwise(F.col("content")))
    docs = as_docs(spark.createDataFrame([("d2", "two"), ("d3", "three")], "doc_id string, content string"))
    for method, want in (("map", {("d3", 1)}), ("fold", {("d3", None)}), ("delta-fold", {("d3", 1)})):
        *_, errors = S.summarize(docs, chunks, batch(M.failing_call), method, "g")
        assert {(r.doc_id, r.chunk_idx) for r in errors.collect()} == want
    *_, errors = S.summarize(docs, chunks, ColumnModel("arr", lambda _s, _u, _n: F.lit("[1]")), "fold", "g", schema={"type": "object"})
    assert {(r.doc_id, r.error.interpreted_type) for r in errors.collect()} == {("d2", "schema_validation_failed"), ("d3", "schema_validation_failed")}


def test_failing_embeddings_are_rows(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc")], "id int, text string").coalesce(1)
    got = {r.id: (r.vector, r.error) for r in embed_texts(texts, BatchModel("m", M.open_none, embed=M.picky_embed)).collect()}
    assert got == {1: ([1.0], None), 2: (None, "ValueError: no vector for this"), 3: ([3.0], None)}


@pytest.mark.parametrize("method", S.METHODS)
def test_summarize_annotates(spark, method):
    chunks = corpus(spark, (2, 3)).withColumn("annotations", F.lit('{"summary":"old","keep":true}'))
    docs = as_docs(spark.createDataFrame([("d2", "two"), ("d3", "three"), ("d0", "none")], "doc_id string, content string"))
    out_docs, out_chunks, errors = S.summarize(docs, chunks, digest_model(), method, None if method == "full" else "g", merge_mode="hierarchical")
    notes = {r.doc_id: r.annotations for r in out_docs.collect()}
    parts = [json.loads(r.annotations) for r in out_chunks.collect()]
    assert all(p["keep"] is True for p in parts) and len(parts) == 5
    if method == "map":
        assert all(v is None for v in notes.values()) and all(len(p["summary"]) == 16 for p in parts)
    else:
        assert len(json.loads(notes["d2"])["summary"]) == (2 if method == "delta-fold" else 16)
    if method == "delta-fold":
        assert all(len(p["summary_delta"]) == 16 and p["summary"] == "old" for p in parts)


def test_delta_append_splices_arrays(spark):
    model = ColumnModel("arr", lambda _s, _u, _n: F.lit('["a","b"]'))
    for mode, want in (("append", ["z", "a", "b", "a", "b"]), ("push", ["z", ["a", "b"], ["a", "b"]])):
        seed = spark.createDataFrame([("d2", '["z"]')], "doc_id string, deltas string")
        whole, _ = S.summarize_delta_fold(corpus(spark, (2,)), model, "g", schema={"type": "array"}, json_sum=mode, initial=seed)
        assert json.loads(whole.first().summary) == want


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        S.summarize(None, None, digest_model(), "shrink", "g")


def test_distinct_prompts_are_asked_once(spark):
    out = complete_distinct(requests(spark, *["same"] * 50, "other"), batch(M.digest_call)).collect()
    assert len(out) == 51 and len({r.reply for r in out if r.user == "same"}) == 1 and all(r.reply for r in out)


def test_embeddings(spark):
    model = BatchModel("len", M.open_none, embed=M.embed_lengths)
    chunks = corpus(spark, (3,)).unionByName(corpus(spark, (3,)).withColumn("doc_id", F.lit("copy")))
    rows = embed_chunks(chunks, model, "g").collect()
    assert len(rows) == 6 and all(list(r.vector) == [11.0, 1.0] for r in rows) and rows[0].model == "len"
    assert embed_texts(spark.createDataFrame([("abc",)], "text string"), model).first().vector == [3.0, 1.0]
    with pytest.raises(ValueError):
        embed_chunks(chunks, digest_model(), "g")


def tool_set():
    return ToolRegistry([echo_tool(), calculator_tool(), ToolSpec("pick_file", kind="client"), ToolSpec.from_function(M.double)])


def test_tool_goldens(spark):
    calls = [("echo", '{"message":"Direct execution test"}'), ("calculator", '{"operation":"multiply","a":12,"b":34}'), ("calculator", '{"operation":"add","a":5,"b":3}'),
             ("calculator", '{"operation":"divide","a":1,"b":0}'), ("calculator", '{"operation":"divide","a":1,"b":8}'), ("nope", "{}"), ("pick_file", "{}"), ("double", '{"x":21}'), ("double", '{"y":1}')]
    df = spark.createDataFrame([(str(i), n, a) for i, (n, a) in enumerate(calls)], "call_id string, tool_name string, arguments string")
    got = {int(r.call_id): (r.content, r.error) for r in execute_tool_calls(df, tool_set()).collect()}
    assert json.loads(got[0][0]) == {"message": "Direct execution test"} and json.loads(got[1][0])["result"] == 408 and json.loads(got[2][0])["result"] == 8
    assert got[3] == (None, "Division by zero") and json.loads(got[4][0])["result"] == 0.125 and got[5] == (None, "Tool not found: nope")
    assert got[6][1] == "Client tools cannot be executed on the server" and json.loads(got[7][0]) == {"result": 42} and got[8][0] is None and "y" in got[8][1]


def test_registry():
    tools = tool_set()
    tools.register(ToolSpec("echo", "second"))
    assert tools.get("echo").description != "second" and tools.has_client_tools() and [t.name for t in tools.by_kind("client")] == ["pick_file"]
    assert tools.get("double").input_schema["required"] == ["x"] and tools.get("double").description == "Doubles x."
    tools.unregister("pick_file")
    assert not tools.has_client_tools()


def test_tool_rounds(spark):
    users = {"a": "calc please", "b": "client please", "c": "just talk", "d": "loop"}
    turns = T.text_turns(spark.createDataFrame([(k, 0, "user", v) for k, v in users.items()], "conv_id string, turn int, role string, text string"))
    suffix, errors = extend_transcripts(turns, batch(M.tool_call_model), tools=tool_set(), max_rounds=2)
    by = {}
    for r in suffix.orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append(r)
    assert [(r.conv_id, r.error.interpreted_type) for r in errors.collect()] == [("d", "tool_rounds_exhausted")]
    assert [(r.turn, r.role) for r in by["a"]] == [(1, "tool_call"), (2, "tool_response"), (3, "assistant")]
    assert [p.call_id for p in by["a"][0].parts] == ["c1", "call-1-1"] and '"result":408' in by["a"][2].parts[0].text
    assert [(r.turn, r.role) for r in by["b"]] == [(1, "tool_call"), (2, "tool_response"), (3, "tool_call")]
    assert by["b"][2].parts[0].tool_name == "pick_file" and by["b"][2].parts[0].rationale == "need it"
    assert [r.role for r in by["c"]] == ["assistant"]
    assert [r.role for r in by["d"]] == ["tool_call", "tool_response"] * 3
    both = turns.unionByName(suffix)
    assert [r.call_id for r in T.pending_tool_calls(both).collect()] == ["p"]
    # The client answers; the conversation goes on from there.
    reply = spark.createDataFrame([("b", 4)], "conv_id string, turn int").select("conv_id", "turn", F.lit("tool_response").alias("role"), F.array(
        T.part("tool_response", tool_name=F.lit("pick_file"), call_id=F.lit("p"), response=F.lit('"file.txt"'))).alias("parts"))
    more, _ = extend_transcripts(both.where("conv_id = 'b'").unionByName(reply), batch(M.tool_call_model), tools=tool_set())
    assert more.first().turn == 5 and more.first().parts[0].text == "tools said file.txt"
