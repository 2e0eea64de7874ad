"""The pipeline stage by stage against direct implementations, each on its own input."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import classes_of
from tokenizers import Tokenizer

import corpus_pipeline as P
from docflow.llm import decontam
from docflow.llm.scratch import scratch_dir, staged

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Name → (input rows, output rows) over the documents and some odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "x", 0), (None, "no id here", None, "x", 10), (9003, "no id here", "en", None, 10),
                                 (9004, "a " * 30_000, "en", "x", 60_000), (9005, "a " * 30_000, "en", "x", 60_000)], docs.schema)
    docs, folder, out = docs.unionByName(odd), scratch_dir(spark), {}
    for name, stage in P.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF), folder, name)
        out[name] = (before.collect(), docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == COLUMNS and docs.schema == before.schema
    return out


def key(rows):
    return collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "bpe"]


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not key(after) - key(before)
    gone = key(before) - key(after)
    clean = [r for r in before if toxic.get(r.doc_id) == 0]
    assert sum(key([r]) <= gone for r in clean) <= 0.05 * len(clean)


def test_exact_dedup_stage(stages):
    before, after = stages["exact_dedup"]
    last = {}
    for r in before:
        last[r.text or ""] = max(last.get(r.text or "", (False, 0)), (r.doc_id is not None, r.doc_id or 0))
    assert key(after) == key(r for r in before if last[r.text or ""] == (r.doc_id is not None, r.doc_id or 0))


def test_repeated_rows_leave_one(spark):
    rows = [(7, "loaded twice", "en", "x", 12)] * 2 + [(None, "without an id", "en", "x", 13)] * 3
    left = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[1:3]:
        left = stage(spark, left, SF)
        assert left.columns == COLUMNS and key(left.collect()) == {rows[0]: 1, rows[2]: 1}


def test_near_copies_stage(stages):
    before, after = stages["jaccard_join"]
    named = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in before)
    least = classes_of(named, 5, 80)
    assert key(after) == key(r for r in before if least[r.doc_id if r.doc_id is not None else -1][1] == (r.doc_id if r.doc_id is not None else -1))


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [decontam.shingled(decontam.words_of(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda r: any(len(i & decontam.shingled(decontam.words_of((r.text or "").encode()))) >= 0.8 * len(i) for i in items)
    assert key(after) == key(r for r in before if not leaks(r)) and len(after) < len(before)


def test_encoding_stage(stages):
    before, after = stages["bpe"]
    ref = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    got = collections.Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded) for r in after)
    assert got == collections.Counter((r.doc_id, tuple(ids := ref.encode(r.text or "", add_special_tokens=False).ids), len(ids), r.text or "") for r in before)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else docs.withColumn("text", F.lit(""))
