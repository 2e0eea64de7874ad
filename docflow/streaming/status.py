"""Job status kept by a stream.

The counts of every job are the stream's state: a run adds what arrived since the last one, so it costs the new outcomes
and not all of them, and a run that starts again goes on from the state of its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.jobs import job_progress


def run_status(spark: SparkSession, input_dir: str, schema: str, outcomes: Callable[[DataFrame], DataFrame], output_dir: str, checkpoint: str,
               source: str = "parquet", max_files: int | None = None, options: dict[str, str] | None = None):
    """Add the outcomes in the files that arrived since the last run to their jobs, then stop.

    ``outcomes`` turns input rows into (job_id, state). Each trigger overwrites its own folder ``batch_id=N`` with the
    jobs it touched as they stand after it, so a trigger replayed after a failure leaves the same rows.
    """
    reader = spark.readStream.schema(schema).format(source).options(**(options or {}))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output_dir}/batch_id={batch_id}")

    query = (job_progress(outcomes(reader.load(input_dir))).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def read_status(spark: SparkSession, output_dir: str) -> DataFrame:
    """(job_id, total, completed, failed, percent, status) of every job after the last trigger that touched it."""
    rows = spark.read.parquet(output_dir)
    names = [c for c in rows.columns if c not in ("job_id", "batch_id")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*names), "batch_id").alias("s")).select("job_id", "s.*")
