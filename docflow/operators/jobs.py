"""Progress of jobs from their per-chunk outcomes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_total(chunks: int) -> int:
    """Steps of a map-merge job: one per chunk and one per merge."""
    return chunks + max(chunks - 1, 0)


def job_progress(outcomes: DataFrame) -> DataFrame:
    """(job_id, total, completed, failed, percent, status) from ``outcomes(job_id, state)``.

    ``state`` is pending, processing, done or error. Counts are combined map-side, so a job
    with most of all rows costs its tasks one row each.
    """
    state = F.col("state")
    counts = outcomes.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(state == "done").alias("completed"),
        F.count_if(state == "error").alias("failed"), F.count_if(state == "pending").alias("_waiting"))
    status = (F.when(F.col("failed") > 0, "error").when(F.col("completed") == F.col("total"), "complete")
              .when(F.col("_waiting") == F.col("total"), "pending").otherwise("processing"))
    return counts.withColumn("percent", F.floor(F.col("completed") * 100 / F.col("total")).cast("long")).withColumn("status", status).drop("_waiting")


def job_results(outcomes: DataFrame) -> DataFrame:
    """First error of each failed job, in chunk order."""
    failed = outcomes.where(F.col("state") == "error")
    return failed.groupBy("job_id").agg(F.min_by("error", "chunk_idx").alias("error"))
