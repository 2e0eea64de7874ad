"""Vectors of chunk texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.plans.models import BatchModel, ColumnModel, salted_join
from docflow.session import cut_lineage


def embed_texts(texts: DataFrame, model: ColumnModel | BatchModel, text: str = "text") -> DataFrame:
    """Add ``vector`` and ``error`` to a table of texts; a text whose call fails has an error and no vector.

    A failing batch is asked again text by text, so one text cannot take others with it.
    """
    if isinstance(model, ColumnModel):
        if model.vector is None:
            raise ValueError(f"model {model.name} does not embed")
        return texts.withColumn("vector", model.vector(F.col(text))).withColumn("error", F.lit(None).cast("string"))
    if model.embed is None:
        raise ValueError(f"model {model.name} does not embed")

    def run(batches):
        client = model.open()

        def embedded(values: list) -> list[tuple[list | None, str | None]]:
            try:
                found = [([float(x) for x in v], None) for v in model.embed(client, values)]
                if len(found) != len(values):
                    raise ValueError(f"{len(found)} vectors for {len(values)} texts")
                return found
            except Exception as err:  # noqa: BLE001  a model may raise anything; the row keeps it
                if len(values) == 1:
                    return [(None, f"{type(err).__name__}: {err}")]
                return [one for v in values for one in embedded([v])]

        for pdf in batches:
            found = embedded(list(pdf[text])) if len(pdf) else []
            yield pdf.assign(vector=[v for v, _ in found], error=[e for _, e in found])

    fields = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes)
    if model.parallelism:
        texts = texts.repartition(model.parallelism)
    return cut_lineage(texts.mapInPandas(run, f"{fields}, vector array<float>, error string"))


def embed_chunks(chunks: DataFrame, model: ColumnModel | BatchModel, group: str = "pages") -> DataFrame:
    """(doc_id, chunk_group, chunk_idx, chunk_id, model, vector, error) of a group's resolved texts.

    With a BatchModel every distinct text is embedded once: copies collapse map-side by
    hash and get the vector back through a salted join. A ColumnModel costs less than the
    shuffle, so it runs in place.
    """
    rows = chunks.where(F.col("chunk_group") == group).select("doc_id", "chunk_group", "chunk_idx", "chunk_id", F.coalesce("content", F.lit("")).alias("text"))
    if isinstance(model, ColumnModel):
        done = embed_texts(rows, model)
    else:
        keyed = rows.withColumn("_k", F.sha2("text", 256))
        once = keyed.groupBy("_k").agg(F.first("text").alias("text"))
        done = salted_join(keyed.drop("text"), embed_texts(once, model).select("_k", "vector", "error"), "_k").drop("_k")
    return done.select("doc_id", "chunk_group", "chunk_idx", "chunk_id", F.lit(model.name).alias("model"), "vector", "error")
