"""Ordered work inside groups of any size.

A document may hold a third of all chunks, so nothing here puts a whole group into
one task. The dense index of a group is cut into blocks; windows run per
(group, block), and only one small row per block is combined across a group.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096          # rows of scalars per block
TEXT_BLOCK = 256      # rows of text per block
# Longest text put into one cell. A longer document keeps its text in its chunk
# group, which the data model allows (content_chunk_group).
TEXT_CELL_LIMIT = 512 * 1024 * 1024


def block_no(idx: str | Column, size: int = BLOCK) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(idx / F.lit(size)).cast("long")


def block_prefix(totals: DataFrame, keys: list[str], sums: dict[str, str],
                 block: str = "_blk") -> DataFrame:
    """Running sums over the blocks before each one; ``totals`` has one row per block."""
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, block, *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(out)
                                         for out, c in sums.items()])


def running_before(df: DataFrame, keys: list[str], idx: str, values: dict[str, Column]) -> DataFrame:
    """Exclusive running sums of ``values`` (name → expression) along ``idx`` in each group."""
    blocked = df.withColumn("_blk", block_no(idx))
    names = list(values)
    totals = blocked.groupBy(*keys, "_blk").agg(*[F.sum(values[n]).alias(f"_t_{n}") for n in names])
    base = block_prefix(totals, keys, {f"_b_{n}": f"_t_{n}" for n in names})
    w = (Window.partitionBy(*keys, "_blk").orderBy(idx)
         .rowsBetween(Window.unboundedPreceding, -1))
    inner = blocked.select("*", *[F.coalesce(F.sum(values[n]).over(w), F.lit(0)).alias(f"_w_{n}")
                                  for n in names])
    joined = inner.join(base, [*keys, "_blk"], "left")
    for n in names:
        joined = joined.withColumn(n, (F.col(f"_w_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).cast("long"))
    return joined.drop("_blk", *[f"_w_{n}" for n in names], *[f"_b_{n}" for n in names])


def with_frames(df: DataFrame, keys: list[str], idx: str, before: int, after: int,
                columns: dict[str, tuple[Column, int, int]], size: int = BLOCK) -> DataFrame:
    """Windowed columns over rows ``idx - before … idx + after``.

    ``columns`` maps a name to (aggregate, from, to) in row offsets. Rows close to a
    block border are copied into the neighbouring block, so each window sees every row
    it needs while no window partition exceeds ``size + before + after`` rows.
    """
    i = F.col(idx)
    first = F.greatest(block_no(i - F.lit(after), size), F.lit(0).cast("long"))
    spread = (df.withColumn("_home", block_no(i, size))
              .withColumn("_blk", F.explode(F.sequence(first, block_no(i + F.lit(before), size)))))
    base = Window.partitionBy(*keys, "_blk").orderBy(idx)
    framed = spread.select("*", *[agg.over(base.rowsBetween(lo, hi)).alias(name)
                                  for name, (agg, lo, hi) in columns.items()])
    return framed.where(F.col("_home") == F.col("_blk")).drop("_home", "_blk")


def concat_ordered(df: DataFrame, keys: list[str], idx: str, text: str, separator: str,
                   out: str = "content", limit: int | Column | None = TEXT_CELL_LIMIT, size: str | None = None) -> DataFrame:
    """Ordered string aggregation per group, in two steps: per block, then per group.

    A group whose text exceeds ``limit`` characters, a number or a column over ``keys``, gets NULL (its rows keep the
    text); None if the caller has left out such groups. ``size`` may name a column with the length of ``text``; sizes are then summed without reading the texts.
    """
    blocked = df.withColumn("_blk", block_no(idx, TEXT_BLOCK))
    parts = blocked.groupBy(*keys, "_blk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"),
                                                                      F.col(text).alias("t")))),
                                 lambda x: x["t"]), separator).alias("_text"))
    joined = lambda rows: rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_text"))), lambda x: x["_text"]), separator).alias(out))
    if limit is None:
        return joined(parts)
    # Sizes are summed apart from the texts, so the text of a group too long for a cell is never moved.
    over = (df.groupBy(*keys).agg(F.sum((F.col(size) if size else F.length(text)) + len(separator)).alias("_n"))
            .where(F.col("_n") > limit).select(*keys))
    whole = joined(parts.join(over, keys, "left_anti"))
    return whole.unionByName(over.withColumn(out, F.lit(None).cast("string")))


def quantile_bounds(df: DataFrame, col: str, parts: int) -> list:
    """At most ``parts`` increasing cut points of a column (a bounded driver result)."""
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.agg(F.percentile_approx(col, probs, F.lit(10_000))).first()
    return sorted({v for v in (row[0] or []) if v is not None})


def _range_no(bounds: list, value: Column) -> Column:
    """How many of the increasing ``bounds`` are at most ``value``, in about 2·√n comparisons."""
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, round(len(bounds) ** 0.5))
    array = lambda items: F.array(*[F.lit(b) for b in items])
    below = lambda items: F.size(F.filter(items, lambda b: b <= value))
    inner = lambda g: F.greatest((g - 1) * step, F.lit(0)) + below(F.slice(array(bounds), F.greatest((g - 1) * step, F.lit(0)) + 1, F.lit(step)))
    return F.transform(F.array(below(array(bounds[::step]))), inner)[0].cast("long")


def tie_safe_ranges(df: DataFrame, order: str, parts: int, out: str = "_blk") -> DataFrame:
    """Number ``out`` of the range of values each row lies in, ascending with ``order``. A value that many rows share is cut
    by a hash of the row into as many ranges as quantiles it fills, so ties make no range larger than others."""
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = [v for v in (df.agg(F.percentile_approx(order, probs, F.lit(10_000))).first()[0] or []) if v is not None] if parts > 1 else []
    bounds, ties = sorted(set(found)), {v: n for v, n in Counter(found).items() if n > 1}
    no, sub = _range_no(bounds, F.col(order)), F.lit(0)
    if ties:
        kind = df.schema[order].dataType
        look = lambda pairs, key: F.element_at(F.create_map(*[c for pair in pairs for c in pair]), key)
        width = look([(F.lit(v).cast(kind), F.lit(n)) for v, n in ties.items()], F.col(order))
        hashed = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t])
        # A range begins with its bound: what is greater comes behind the parts of a shared bound.
        behind = look([(F.lit(bounds.index(v) + 1).cast("long"), F.lit(n)) for v, n in ties.items()], no)
        sub = F.coalesce(F.pmod(hashed, width), behind, F.lit(0))
    return df.withColumn(out, (no * parts + sub).cast("long"))


def dense_index(df: DataFrame, keys: list[str], order: str, out: str, parts: int | None = None) -> DataFrame:
    """0-based position of each row in its group by a numeric ``order`` column.

    Groups are cut by value ranges, numbered per range, and shifted by the counts of
    the ranges before. The cut points only balance the work; any cuts give the same index,
    but for rows equal in ``order``, which come in any order.
    """
    spark = df.sparkSession
    parts = parts or min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1024)
    ranged = tie_safe_ranges(df, order, parts)
    totals = ranged.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    base = block_prefix(totals, keys, {"_base": "_n"})
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    return (ranged.withColumn("_rn", F.row_number().over(w) - 1)
            .join(base, [*keys, "_blk"])
            .withColumn(out, (F.col("_rn") + F.col("_base")).cast("int"))
            .drop("_blk", "_rn", "_base"))


def last_before(df: DataFrame, keys: list[str], idx: str, value: Column, out: str) -> DataFrame:
    """Latest non-null ``value`` of the rows before each one, in groups of any size."""
    blocked = df.withColumn("_blk", block_no(idx))
    ends = (blocked.groupBy(*keys, "_blk").agg(F.max_by(value, F.when(value.isNotNull(), F.col(idx))).alias("_v")))
    over = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_blk", F.last("_v", ignorenulls=True).over(over).alias("_c"))
    w = Window.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return (blocked.withColumn("_w", F.last(value, ignorenulls=True).over(w))
            .join(carried, [*keys, "_blk"], "left")
            .withColumn(out, F.coalesce("_w", "_c")).drop("_w", "_c", "_blk"))
