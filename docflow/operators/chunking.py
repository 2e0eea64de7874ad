"""Chunk packing by token budget.

Greedy packing is a serial scan per document, but its state at any chunk border is one
number: how many tokens the open buffer holds. So the scan runs in blocks of chunks:

1. token counts per chunk, gathered per (document, block) - only index/count pairs;
2. for full blocks (documents longer than a block) a table from buffer size at entry to
   buffer size at exit, composed by runs of blocks, which gives the true entry sizes;
3. the packing fold of every block from its entry size, in parallel;
4. texts joined to the resulting ranges by (document, chunk), cut and concatenated per
   output chunk - a group bounded by the token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import join_tokens, token_count, token_slices, tokens
from docflow.operators.ordering import BLOCK, block_no, running_before
from docflow.operators.tree import docs_as_nodes, level_of, nodes_as_docs
from docflow.schemas import as_chunks


def chunk_group(chunks: DataFrame, group: str) -> DataFrame:
    return chunks.where(F.col("chunk_group") == group)


def merged_group_name(group: str, max_tokens: int, encoding: str) -> str:
    return f"{group}:merged({max_tokens},{encoding})"


def split_group_name(group: str, max_tokens: int, encoding: str) -> str:
    return f"{group}:splitOversized({max_tokens},{encoding})"


# --- entry state of each block -------------------------------------------------

AT_ONCE = 1024        # blocks whose states are composed in one group


def _exit_table(counts: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every buffer size at block entry: (buffer size at exit, chunks closed)."""
    size = np.arange(limit + overlap + 1, dtype=np.int64)
    closed = np.zeros_like(size)
    stride = limit - overlap
    for n in counts:
        if n > limit:
            slices = 1 + -(-(n - limit) // stride)
            closed += (size > 0) + slices
            size[:] = min(overlap, n - (slices - 1) * stride)
        else:
            flush = (size + n > limit) & (size > 0)
            closed += flush
            size = np.where(flush, np.minimum(size, overlap), size) + n
    return size, closed


RUNS = "starts array<long>, sizes array<long>, closed array<long>"


def _as_runs(size: np.ndarray, closed: np.ndarray, starts: np.ndarray | None = None) -> tuple[list, list, list]:
    """A table as runs of entry sizes with equal results. Scans from different entry sizes meet soon, so there are few."""
    step = np.diff(np.stack([size, closed]), axis=1).any(axis=0)
    at = np.concatenate([[0], np.flatnonzero(step) + 1])
    return (at if starts is None else starts[at]).tolist(), size[at].tolist(), closed[at].tolist()


def _through(row, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes at exit and chunks closed of a block, or of a run of blocks, for sizes at entry."""
    k = np.searchsorted(np.asarray(row.starts), entry, side="right") - 1
    return np.asarray(row.sizes)[k], np.asarray(row.closed)[k]


def _composed(pdf):
    """The tables of neighbouring blocks as one table."""
    import pandas as pd
    rows = list(pdf.sort_values("_blk").rename(columns={"_up": "up"}).itertuples(index=False))
    starts = np.asarray(rows[0].starts)
    size, closed = starts, np.zeros_like(starts)
    for row in rows:
        size, more = _through(row, size)
        closed = closed + more
    runs = _as_runs(size, closed, starts)
    return pd.DataFrame([(rows[0].doc_id, rows[0].up, *runs)], columns=["doc_id", "_up", "starts", "sizes", "closed"])


def _chained(number: str):
    """The states before each of the tables of a group, from ``entry`` and ``out_base`` before the first."""
    def chain(pdf):
        import pandas as pd
        out, entry, base = [], None, 0
        for row in pdf.sort_values(number).rename(columns={"_blk": "blk", "_up": "up"}).itertuples(index=False):
            if entry is None:
                entry, base = np.array([row.entry]), row.out_base
            out.append((row.doc_id, getattr(row, number[1:]), int(entry[0]), int(base)))
            entry, more = _through(row, entry)
            base += int(more[0])
        return pd.DataFrame(out, columns=["doc_id", number, "entry", "out_base"])
    return chain


def _entry_states(blocks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(doc_id, _blk, entry, out_base) of every block of the documents with several, however many index values lie between.

    Tables of block states compose associatively. Those of ``AT_ONCE`` neighbouring blocks become one, these are
    chained by document (an index is an int, so there are few), and then each run of blocks from its own entry
    state. No group holds the blocks of a whole document.
    """
    def tables(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for doc, blk, items in zip(pdf.doc_id, pdf["_blk"], pdf["items"]):
                counts = np.array([x["n"] for x in items], dtype=np.int64)
                rows.append((doc, blk, *_as_runs(*_exit_table(counts, limit, overlap))))
            yield pd.DataFrame(rows, columns=["doc_id", "_blk", "starts", "sizes", "closed"])

    # Documents of one block, nearly all of them, need no states.
    several = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_blk").alias("_last")).where("_n > 1").select("doc_id", "_last")
    made = (blocks.select("doc_id", "_blk", "items").join(several, "doc_id").select("doc_id", "_blk", "items")
            .mapInPandas(tables, f"doc_id string, _blk long, {RUNS}").withColumn("_up", F.floor(F.col("_blk") / AT_ONCE)))
    long = several.where(F.col("_last") >= AT_ONCE).select("doc_id")
    nothing = {"entry": F.lit(0).cast("long"), "out_base": F.lit(0).cast("long")}
    states = "entry long, out_base long"
    runs = made.join(long, "doc_id", "left_semi").groupBy("doc_id", "_up").applyInPandas(_composed, f"doc_id string, _up long, {RUNS}")
    tops = runs.withColumns(nothing).groupBy("doc_id").applyInPandas(_chained("_up"), f"doc_id string, _up long, {states}")
    entered = made.join(tops, ["doc_id", "_up"], "left").withColumns({c: F.coalesce(c, v) for c, v in nothing.items()})
    return entered.groupBy("doc_id", "_up").applyInPandas(_chained("_blk"), f"doc_id string, _blk long, {states}")


def _blocks(counted: DataFrame, block: int) -> DataFrame:
    return (counted.groupBy("doc_id", block_no("chunk_idx", block).alias("_blk"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_idx").alias("idx"),
                                                      F.col("n").cast("long").alias("n")))).alias("items")))


def _with_entries(blocks: DataFrame, limit: int, overlap: int) -> DataFrame:
    entries = _entry_states(blocks, limit, overlap)
    return (blocks.join(entries, ["doc_id", "_blk"], "left")
            .withColumn("entry", F.coalesce("entry", F.lit(0).cast("long")))
            .withColumn("out_base", F.coalesce("out_base", F.lit(0).cast("long"))))


# --- the packing folds ----------------------------------------------------------

FOLD = 64
_PIECE = "struct<out:bigint,lo:bigint,hi:bigint>"


def _assign_pieces(limit: int) -> Column:
    """Fold without overlap: per chunk the output chunk(s) it goes to, as token ranges."""
    m = f"{limit}L"
    piece = "named_struct('out', {o}, 'lo', {lo}, 'hi', {hi})"
    row = f"concat(s.rows, array(named_struct('idx', x.idx, 'n', x.n, 'pieces', {{p}})))"
    first = "s.out + if(s.size > 0, 1L, 0L)"
    k = f"cast(ceil(x.n / {limit}) as bigint)"
    slices = (f"transform(sequence(0L, {k} - 1L), i -> "
              + piece.format(o=f"{first} + i", lo=f"i * {m}", hi=f"least((i + 1L) * {m}, x.n)") + ")")
    fresh = f"array({piece.format(o='s.out + 1L', lo='0L', hi='x.n')})"
    same = f"array({piece.format(o='s.out', lo='0L', hi='x.n')})"
    rows_type = f"array<struct<idx:int,n:bigint,pieces:array<{_PIECE}>>>"
    step = f"""(s, x) -> case
            when x.n = 0 then s
            when x.n > {m} then named_struct('size', 0L, 'out', {first} + {k}, 'rows', {row.format(p=slices)})
            when s.size > 0 and s.size + x.n > {m}
              then named_struct('size', x.n, 'out', s.out + 1L, 'rows', {row.format(p=fresh)})
            else named_struct('size', s.size + x.n, 'out', s.out, 'rows', {row.format(p=same)}) end"""
    # Appending copies the rows so far, so the fold runs in runs of FOLD chunks whose
    # row arrays are flattened once at the end.
    return F.expr(f"""
        aggregate(transform(sequence(0, (size(items) - 1) div {FOLD}), k -> slice(items, cast(k as int) * {FOLD} + 1, {FOLD})),
          named_struct('size', entry, 'out', 0L, 'parts', cast(array() as array<{rows_type}>)),
          (o, run) -> transform(
            array(aggregate(run, named_struct('size', o.size, 'out', o.out, 'rows', cast(array() as {rows_type})), {step})),
            r -> named_struct('size', r.size, 'out', r.out, 'parts', concat(o.parts, array(r.rows))))[0],
          o -> flatten(o.parts))""")


def _emit_ranges(limit: int, overlap: int) -> Column:
    """Fold with overlap: closed ranges in the token stream of the block (from its start)."""
    m, v, stride = f"{limit}L", f"{overlap}L", limit - overlap
    rng = "named_struct('lo', {lo}, 'hi', {hi})"
    flush = f"if(s.p > s.b, array({rng.format(lo='s.b', hi='s.p')}), cast(array() as array<struct<lo:bigint,hi:bigint>>))"
    k = f"(1L + cast(ceil((x.n - {m}) / {stride}) as bigint))"
    slices = (f"transform(sequence(0L, {k} - 1L), i -> "
              + rng.format(lo=f"s.p + i * {stride}L", hi=f"s.p + least(i * {stride}L + {m}, x.n)") + ")")
    return F.expr(f"""
        aggregate(items,
          named_struct('b', -entry, 'p', 0L, 'out', cast(array() as array<struct<lo:bigint,hi:bigint>>)),
          (s, x) -> case
            when x.n > {m} then named_struct(
              'b', s.p + x.n - least({v}, x.n - ({k} - 1L) * {stride}L),
              'p', s.p + x.n, 'out', concat(s.out, {flush}, {slices}))
            when s.p - s.b + x.n > {m} and s.p > s.b then named_struct(
              'b', greatest(s.b, s.p - {v}), 'p', s.p + x.n, 'out', concat(s.out, {flush}))
            else named_struct('b', s.b, 'p', s.p + x.n, 'out', s.out) end)""")


def _pieces_plain(counted: DataFrame, limit: int, block: int) -> DataFrame:
    placed = _with_entries(_blocks(counted, block), limit, 0)
    rows = placed.select("doc_id", "out_base", F.explode(_assign_pieces(limit)).alias("r"))
    shifted = F.transform("r.pieces", lambda p: F.struct(
        (p["out"] + F.col("out_base")).alias("out"), p["lo"].alias("lo"), p["hi"].alias("hi")))
    return rows.select("doc_id", F.col("r.idx").alias("chunk_idx"), F.col("r.n").alias("n"),
                       shifted.alias("pieces"))


def _pieces_overlap(counted: DataFrame, limit: int, overlap: int, block: int) -> DataFrame:
    keyed = counted.withColumn("_blk", block_no("chunk_idx", block))
    along = Window.partitionBy("doc_id").orderBy("_blk")
    # One small row per block: tokens before it, and whether it is the document's last.
    bases = keyed.groupBy("doc_id", "_blk").agg(F.sum("n").alias("_t")).select(
        "doc_id", "_blk", F.lead("_blk").over(along).isNull().alias("is_last"),
        F.coalesce(F.sum("_t").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tok_base"))
    blocks = _with_entries(_blocks(counted, block), limit, overlap).join(bases, ["doc_id", "_blk"])
    folded = blocks.select("doc_id", "out_base", "tok_base", "is_last", _emit_ranges(limit, overlap).alias("s"))
    # The buffer still open after the document's last block is its final chunk.
    open_end = F.when(F.col("is_last") & (F.col("s.p") > F.col("s.b")),
                      F.array(F.struct(F.col("s.b").alias("lo"), F.col("s.p").alias("hi"))))
    closed = F.concat("s.out", F.coalesce(open_end, F.array().cast("array<struct<lo:bigint,hi:bigint>>")))
    ranges = folded.select("doc_id", "out_base", "tok_base", F.posexplode(closed).alias("i", "r")).select(
        "doc_id", (F.col("out_base") + F.col("i")).alias("out"),
        (F.col("tok_base") + F.col("r.lo")).alias("lo"), (F.col("tok_base") + F.col("r.hi")).alias("hi"))
    inside = Window.partitionBy("doc_id", "_blk").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    places = (keyed.withColumn("_w", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .join(bases.select("doc_id", "_blk", "tok_base"), ["doc_id", "_blk"])
              .select("doc_id", "chunk_idx", "n", (F.col("_w") + F.col("tok_base")).alias("p0")).where(F.col("n") > 0))
    # Range join on buckets of the token stream; a bucket holds at most `width` tokens.
    width = limit + overlap
    left = ranges.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    right = places.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("p0") / width), F.floor((F.col("p0") + F.col("n") - 1) / width))))
    met = left.join(right, ["doc_id", "bucket"]).where(
        (F.col("bucket") == F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("p0") / width)))
        & (F.col("lo") < F.col("p0") + F.col("n")) & (F.col("p0") < F.col("hi")))
    return met.groupBy("doc_id", "chunk_idx").agg(
        F.first("n").alias("n"),
        F.collect_list(F.struct("out", (F.greatest("lo", "p0") - F.col("p0")).alias("lo"),
                                (F.least(F.col("hi"), F.col("p0") + F.col("n")) - F.col("p0")).alias("hi"))
                       ).alias("pieces"))


def _cut(content: Column, pieces: Column, n: Column, encoding: str) -> Column:
    """Text of each piece of one chunk; the text is tokenised only where it is cut."""
    uncut = (F.size(pieces) == 1) & (pieces[0]["lo"] == 0) & (pieces[0]["hi"] == n)
    whole = F.array(F.struct(pieces[0]["out"].alias("out"), n.alias("k"), content.alias("t")))
    # An encoding may be a Python function, which is called for the rows of both branches: those left whole are NULL to it.
    texts = token_slices(F.when(~uncut, content), pieces, encoding)
    cut = F.zip_with(pieces, texts, lambda p, t: F.struct(p["out"].alias("out"), (p["hi"] - p["lo"]).alias("k"), t.alias("t")))
    return F.when(uncut, whole).otherwise(cut)


def merge_chunks(chunks: DataFrame, max_tokens: int, group: str = "pages", encoding: str = "words",
                 new_group: str | None = None, overlap_tokens: int = 0, block: int = BLOCK) -> DataFrame:
    """Pack the chunks of ``group`` left to right into chunks of at most ``max_tokens``.

    ``chunks`` carries resolved content. An oversized chunk is cut; with overlap the last
    ``overlap_tokens`` of a closed chunk open the next one (which may then reach
    ``max_tokens + overlap_tokens``). Every owner's group is packed by itself. Returns the new
    group with ``n_tokens``.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be a positive integer")
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("overlap_tokens must be in [0, max_tokens)")
    new_group = new_group or merged_group_name(group, max_tokens, encoding)
    # The explicit null filter keeps the count branches equal, so they share one exchange.
    source = nodes_as_docs(chunk_group(chunks, group)).where(F.col("doc_id").isNotNull() & F.col("chunk_idx").isNotNull()).select(
        "doc_id", "chunk_idx", F.coalesce("content", F.lit("")).alias("content"))
    counted = source.select("doc_id", "chunk_idx", token_count(F.col("content"), encoding).cast("long").alias("n"))
    pieces = (_pieces_overlap(counted, max_tokens, overlap_tokens, block) if overlap_tokens
              else _pieces_plain(counted, max_tokens, block))
    texts = (source.join(pieces, ["doc_id", "chunk_idx"])
             .select("doc_id", "chunk_idx", F.explode(_cut(F.col("content"), F.col("pieces"), F.col("n"),
                                                           encoding)).alias("p"))
             .select("doc_id", "chunk_idx", "p.*"))
    merged = texts.groupBy("doc_id", "out").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "t"))),
                                 lambda x: x["t"]), "").alias("content"),
        F.sum("k").alias("n_tokens"))
    return _new_chunks(merged.withColumnRenamed("out", "chunk_idx"), new_group)


def _new_chunks(df: DataFrame, group: str) -> DataFrame:
    """Chunk rows with fresh ids ``<owner>/<group>@<index>``, from rows whose ``doc_id`` is a node."""
    named = (docs_as_nodes(df).withColumn("chunk_group", F.lit(group))
             .withColumn("chunk_idx", F.col("chunk_idx").cast("int"))
             .withColumn("chunk_id", F.concat("owner_id", F.lit(f"/{group}@"), F.col("chunk_idx").cast("string")))
             .withColumn("parent", F.col("owner_id")).withColumn("depth", level_of(F.col("owner"))))
    return as_chunks(named, extra=["n_tokens"])


def split_oversized(chunks: DataFrame, max_tokens: int, group: str = "pages", encoding: str = "words",
                    new_group: str | None = None) -> DataFrame:
    """Copy chunks that fit (keeping metadata and annotations); cut larger ones every
    ``max_tokens`` tokens. ``chunks`` carries resolved content."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be a positive integer")
    new_group = new_group or split_group_name(group, max_tokens, encoding)
    content = F.coalesce("content", F.lit(""))
    n = token_count(content, encoding).cast("long")
    source = (nodes_as_docs(as_chunks(chunk_group(chunks, group)))
              .select("doc_id", "chunk_idx", content.alias("content"), n.alias("n"), "metadata", "annotations")
              .withColumn("k", F.greatest(F.ceil(F.col("n") / max_tokens), F.lit(1)).cast("long")))
    numbered = running_before(source, ["doc_id"], "chunk_idx", {"base": F.col("k")})
    cut = F.transform(F.array(tokens(F.col("content"), encoding)), lambda toks: F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("k") - 1),
        lambda i: join_tokens(F.slice(toks, (i * max_tokens + 1).cast("int"), max_tokens), encoding)))[0]
    texts = F.when(F.col("k") == 1, F.array("content")).otherwise(cut)
    fits = F.col("k") == 1
    out = (numbered.select("doc_id", "base", "n", "k", F.when(fits, F.col("metadata")).alias("metadata"),
                           F.when(fits, F.col("annotations")).alias("annotations"),
                           F.posexplode(texts).alias("i", "content"))
           .withColumn("chunk_idx", F.col("base") + F.col("i"))
           .withColumn("n_tokens", F.when(F.col("k") == 1, F.col("n"))
                       .otherwise(F.least(F.lit(max_tokens), F.col("n") - F.col("i") * max_tokens))))
    return _new_chunks(out, new_group)


def chunk_counts(old: DataFrame, new: DataFrame, old_group: str, new_group: str) -> DataFrame:
    """Chunks per document before and after, one pre-aggregated pass."""
    both = (chunk_group(old, old_group).select("doc_id", F.lit(1).alias("o"), F.lit(0).alias("w"))
            .unionByName(chunk_group(new, new_group).select("doc_id", F.lit(0).alias("o"), F.lit(1).alias("w"))))
    return both.groupBy("doc_id").agg(F.sum("o").alias("old_chunk_count"), F.sum("w").alias("new_chunk_count"))


STRATEGIES = {"merge_and_split": "mergedAndSplit", "split_by_token_count": "splitByTokenCount"}


def chunking_job(docs: DataFrame, chunks: DataFrame, strategy: str, chunk_size: int,
                 group: str = "all", encoding: str = "words") -> DataFrame:
    """Chunk every document by a named strategy and list the results.

    Documents without ``group`` get it as one chunk of their full text first.
    """
    from docflow.operators.content import ensure_group, resolve_content
    from docflow.sinks.documents import chunk_listing

    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported strategy: {strategy}")
    if chunk_size < 1:
        raise ValueError(f"invalid chunk_size for {strategy} (must be > 0)")
    texts, resolved = resolve_content(docs, chunks)
    whole = ensure_group(texts, resolved, group)
    new_group = f"{group}:{STRATEGIES[strategy]}"
    op = merge_chunks if strategy == "merge_and_split" else split_oversized
    return chunk_listing(op(whole, chunk_size, group, encoding, new_group), docs)
