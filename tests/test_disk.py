"""What a chain of steps leaves on disk."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from docflow.session import ensure_checkpoint_dir, kept, stored
from docflow.sinks.documents import PART, nest_docs
from docflow.sources.docjson import parse_docs
from docflow.workload import QUERIES


@pytest.fixture
def on_disk(spark):
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files)


def test_steps_delete_what_they_are_made_of(spark, on_disk):
    before = on_disk()

    def make():
        inner = stored(spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")))
        yield inner.where("id < 100")

    few = kept(make)
    assert few[0].count() == 100 and 0 < on_disk() - before < 50_000
    nested = kept(lambda: [kept(make)[0].select("id")])
    assert nested[0].agg(F.sum("id")).first()[0] == 4950
    few.drop(), nested.drop()
    assert on_disk() - before < 1000


def test_nest_roundtrip_leaves_no_texts(spark, on_disk, tmp_path):
    """Texts of more than a part, one master of a single document, copies: the right digests, and no copy of the texts left."""
    rng = random.Random(4)
    line = lambda: "".join(rng.choices('abc de"\\\té\U0001f600', k=rng.randint(0, 900)))
    docs = [(i, "\n".join(line() for _ in range(rng.choice((1, 3, 600)))), "AB"[i % 2]) for i in range(30)] + [(30, line() + "\n" + line(), "C")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("lang", F.lit("en")).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    before = on_disk()
    rows = [tuple(r) for r in QUERIES["nest_roundtrip"](spark, str(tmp_path)).collect()]
    left = on_disk() - before
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want, size = [], 0
    for s in "ABC":
        mine = [(str(i), t.replace("\n", "")) for i, t, x in docs if x == s]
        whole = "".join(t for _, t in mine)
        assert (len(whole) > PART) == (s != "C")
        size += len(whole)
        want += [(sha(s), i if s != "C" else f"{i}_child", k, sha(t)) for k, (i, t) in enumerate(mine)] + [(sha(s), None, None, sha(whole))]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    assert left < size / 20


def test_places_of_parts_with_repeated_indices(spark):
    """Chunks that share indices keep all their places where a group goes on in other objects."""
    docs = spark.createDataFrame([("D", "g")], "doc_id string, content_chunk_group string")
    chunks = spark.range(1400).select(F.lit("D").alias("doc_id"), F.lit("g").alias("chunk_group"), F.floor(F.col("id") / 2).cast("int").alias("chunk_idx"),
                                      F.col("id").cast("string").alias("chunk_id"), F.format_string("text %d", "id").alias("content"))
    from docflow.schemas import as_chunks, as_docs
    objects = nest_docs(as_docs(docs), as_chunks(chunks), part=2000)
    found = [json.loads(r.json) for r in objects.collect()]
    assert max(len(json.dumps(o)) for o in found) < 4000
    _, back, _ = parse_docs(kept(lambda: [objects])[0])
    rows = back.orderBy("chunk_idx").collect()
    assert [r.chunk_idx for r in rows] == list(range(1400)) and [int(r.chunk_id) // 2 for r in rows] == [i // 2 for i in range(1400)]
