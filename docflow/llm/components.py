"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.scratch import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b: longs) but the roots; the root is the least node reachable.

    The number of rounds grows with the logarithm of the longest path; each writes its edges, which
    never grow in number. Stars with many leaves are joins that Spark may split, not groups.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last, no = staged(edges, folder, "edges-0"), None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last, no = state, no + 1
        moved = _large_star(edges).where("a <> b").distinct()
        edges = staged(_small_star(moved).where("a <> b").distinct(), folder, f"edges-{no}")
