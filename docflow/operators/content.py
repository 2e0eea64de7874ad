"""Document text: resolution, combination, neighbours, chunk groups, extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import (annotation, array_texts, bind, comment_lines, compact, delta_text,
                                     json_kind, member, pretty_json)
from docflow.functions.text import trim_all
from docflow.operators.ordering import TEXT_CELL_LIMIT, concat_ordered, dense_index, with_frames
from docflow.operators.rope import SEGMENT, cut_spans, rope_of_cells, rope_of_rows, rope_sha256
from docflow.operators.tree import CHUNK, GROUP, node_key, owned, path_of
from docflow.schemas import as_chunks
from docflow.session import small, stored, work_folder, written


HASHED = 4096       # characters of a part that is hashed, so that a batch of parts stays small


# --- resolution -----------------------------------------------------------------

def is_span(df: DataFrame) -> Column:
    return df["content"].isNull() & df["start"].isNotNull() & df["length"].isNotNull()


def resolve_parts(docs: DataFrame, chunks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The resolved text of every document as a rope (doc_id, seg, part, total), whatever its length: its own content,
    else its content group's chunks in order, else the empty text."""
    cells, members = _text_rows(docs, chunks, _grouped(docs))
    return (rope_of_cells(cells, "doc_id", segment=segment)
            .unionByName(rope_of_rows(members, "doc_id", "chunk_idx", "content", segment=segment)))


def text_sha256(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, sha256) of the resolved text of every document, whatever its length.

    A digest needs no segments of one length: every row is cut for itself, and its pieces go in their order straight to
    the task of their text."""
    cells, members = _text_rows(docs, chunks, stored(_grouped(docs)))
    last = F.floor(F.greatest(F.length("part") - 1, F.lit(0)) / HASHED).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("n"), F.substring(F.col("part"), i * HASHED + 1, F.lit(HASHED)).alias("part")))
    rows = cells.where("text IS NOT NULL").select("doc_id", F.lit(0).alias("i"), F.col("text").alias("part")).unionByName(
        members.select("doc_id", F.col("chunk_idx").alias("i"), F.coalesce("content", F.lit("")).alias("part")))
    cut = rows.select("doc_id", "i", F.explode(pieces).alias("p"))
    return rope_sha256(cut.select("doc_id", F.struct("i", "p.n").alias("seg"), "p.part"), "doc_id")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_group) of the documents whose text is that of a group."""
    return docs.where(F.col("content").isNull() & F.col("content_chunk_group").isNotNull()).select("doc_id", F.col("content_chunk_group").alias("chunk_group"))


def _text_rows(docs: DataFrame, chunks: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, text) of the documents that have them in a cell, and the chunks of all others."""
    content_group = F.col("content_chunk_group")
    members = _own_chunks(chunks).join(grouped, ["doc_id", "chunk_group"], "left_semi")
    # A document whose group has no rows has the empty text.
    found = members.select("doc_id").distinct()
    cells = docs.select("doc_id", F.when(F.col("content").isNotNull() | content_group.isNull(), F.coalesce("content", F.lit(""))).alias("text"))
    return cells.unionByName(grouped.join(found, "doc_id", "left_anti").select("doc_id", F.lit("").alias("text"))), members


def _own_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of documents themselves, without chunks of chunks."""
    return chunks.where(F.coalesce("owner", F.lit("")) == "") if "owner" in chunks.columns else chunks


def resolve_docs(docs: DataFrame, chunks: DataFrame, limit: int = TEXT_CELL_LIMIT) -> DataFrame:
    """Documents with resolved ``content`` in one cell, and ``reason``: their own, else their content
    group's chunks in order, else the empty string. An empty own content stays empty. A group longer than
    ``limit`` characters is NULL with reason ``text_too_long``; ``resolve_parts`` has its text."""
    grouped = docs.where(F.col("content").isNull() & F.col("content_chunk_group").isNotNull())
    members = _own_chunks(chunks).join(grouped.select("doc_id", F.col("content_chunk_group").alias("chunk_group")),
                                       ["doc_id", "chunk_group"], "left_semi")
    texts = concat_ordered(members.withColumn("_t", F.coalesce("content", F.lit(""))),
                           ["doc_id", "chunk_group"], "chunk_idx", "_t", "", "_text", limit).withColumn("_found", F.lit(True))
    joined = docs.join(texts.withColumnRenamed("chunk_group", "content_chunk_group"),
                       ["doc_id", "content_chunk_group"], "left")
    content = F.when(F.col("content").isNull() & F.col("_found").isNull(), F.lit("")).otherwise(
        F.coalesce("content", "_text"))
    return joined.withColumn("content", content).select(*docs.columns, F.when(content.isNull(), F.lit("text_too_long")).alias("reason"))


def resolve_content(docs: DataFrame, chunks: DataFrame, limit: int = TEXT_CELL_LIMIT,
                    doc_limit: int | None = None, files: bool = False) -> tuple[DataFrame, DataFrame]:
    """Resolved (docs, chunks): spans are cut from the text of the node they belong to, content groups are
    joined, at every level of nesting.

    Rows keep all columns; ``content`` is filled and ``reason`` tells why not. Spans of a document too long for
    one cell are cut from its rows like all others. ``doc_limit`` is the limit of the documents' own texts, if it is
    another one than that of chunks; ``resolve_parts`` has the longer ones. ``files`` says that both tables lie in files, so
    their texts are not written again.
    """
    chunks, doc_limit = owned(chunks), limit if doc_limit is None else doc_limit
    deep = stored(chunks.where("owner <> ''").select("doc_id").distinct())
    if deep.isEmpty():
        return _resolve_flat(docs, chunks, doc_limit)
    flat = _resolve_flat(docs.join(deep, "doc_id", "left_anti"), chunks.join(deep, "doc_id", "left_anti"), doc_limit)
    tree = _resolve_tree(docs.join(deep, "doc_id", "left_semi"), chunks.join(deep, "doc_id", "left_semi"), limit, doc_limit, files)
    return flat[0].unionByName(tree[0]), flat[1].unionByName(tree[1])


def _resolve_flat(docs: DataFrame, chunks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Documents without chunks of chunks."""
    spans = chunks.where(is_span(chunks)).select(*CHUNK, "start", "length")
    asked = docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = cut_spans(resolve_parts(asked, chunks), spans, CHUNK, "doc_id")
    joined = chunks.join(texts, CHUNK, "left")
    content = F.when(F.col("content").isNotNull(), F.col("content")).when(
        F.col("start").isNotNull() & F.col("length").isNotNull(), F.col("text")).otherwise(F.lit(""))
    return resolve_docs(docs, chunks, limit), joined.withColumn("content", content).select(*chunks.columns, "reason")


def _resolve_tree(docs: DataFrame, chunks: DataFrame, limit: int, doc_limit: int, files: bool) -> tuple[DataFrame, DataFrame]:
    """Documents with chunks of chunks: every document and chunk is a node, named by its path."""
    node = lambda path: node_key(F.col("doc_id"), path)
    none = lambda kind: F.lit(None).cast(kind)
    doc_rows = docs.withColumn("_node", node(F.lit("")))
    chunk_rows = chunks.withColumn("_node", node(path_of(F.col("owner"), F.col("chunk_group"), F.col("chunk_idx"))))
    nodes = doc_rows.select(F.col("_node").alias("node_id"), none("string").alias("parent_id"), none("string").alias("chunk_group"), none("int").alias("idx"),
                            "content", none("int").alias("start"), none("int").alias("length"), "content_chunk_group",
                            F.lit(doc_limit).alias("most")).unionByName(
        chunk_rows.select(F.col("_node").alias("node_id"), node(F.col("owner")).alias("parent_id"), "chunk_group", F.col("chunk_idx").alias("idx"),
                          "content", "start", "length", "content_chunk_group", F.lit(limit).alias("most")))
    start, logged, shape, unique = _settle(nodes, limit, files)

    def filled(rows: DataFrame, top: bool) -> DataFrame:
        if not unique:
            done, rejects = _outcome(start, logged, shape)
            settled = done.withColumn("reason", none("string")).unionByName(rejects.withColumn("text", none("string")))
            return rows.drop("content").join(settled.withColumnRenamed("node_id", "_node"), "_node", "left").withColumnRenamed("text", "content")
        # Rows that had their text at the start have it still; only what the rounds made is joined.
        kind = _kind(rows["content"], F.lit(None) if top else node(F.col("owner")), *([none("int")] * 2 if top else [rows["start"], rows["length"]]), rows["content_chunk_group"])
        known, named = kind.isin("own", "empty"), F.col("_node").isNotNull()
        made = logged.where(F.col("parent_id").isNull() if top else F.col("parent_id").isNotNull()).select(
            F.col("node_id").alias("_node"), "text", "reason", F.lit(True).alias("_made"))
        own = rows.where(known).withColumn("content", F.when(named, F.coalesce("content", F.lit("")))).withColumn("reason", none("string"))
        late = rows.where(~known).drop("content").join(made, "_node", "left").withColumnRenamed("text", "content").withColumn(
            "reason", F.when(F.col("_made").isNull() & named, F.lit("unresolvable")).otherwise(F.col("reason")))
        return own.unionByName(late.drop("_made"))

    return filled(doc_rows, True).select(*docs.columns, "reason"), filled(chunk_rows, False).select(*chunks.columns, "reason")


def resolve_nested(nodes: DataFrame, limit: int = TEXT_CELL_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Resolve trees of documents inside documents.

    ``nodes(node_id, parent_id, chunk_group, idx, content, start, length,
    content_chunk_group)``, and ``most`` characters of a node's group in one cell if that is not ``limit``. A round resolves what waits for the nodes of the round before: spans of a parent
    just resolved, and content groups whose last open member is. Rounds are appended to a log that is never
    rewritten, and a text is read again only by the round that puts it into its group or cuts spans from it.
    Returns (node_id, text) and rejects (node_id, reason).
    """
    return _outcome(*_settle(nodes, limit)[:3])


def _outcome(start: DataFrame, logged: DataFrame, shape: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, text) and rejects (node_id, reason)."""
    # What no round could reach hangs below a cycle, a reject, or a missing parent.
    left = shape.select("node_id").join(start.select("node_id").unionByName(logged.select("node_id")), "node_id", "left_anti").select(
        "node_id", F.lit("unresolvable").alias("reason"))
    return (start.unionByName(logged).where("reason IS NULL").select("node_id", "text"),
            logged.where("reason IS NOT NULL").select("node_id", "reason").unionByName(left))


def _kind(content: Column, parent_id: Column, start: Column, length: Column, group: Column) -> Column:
    """Where the text of a node comes from."""
    span = content.isNull() & parent_id.isNotNull() & start.isNotNull() & length.isNotNull()
    return F.when(content.isNotNull(), "own").when(span, "span").when(group.isNotNull(), "group").otherwise("empty")


def _settle(nodes: DataFrame, limit: int, files: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Rounds of ``resolve_nested``: texts there were at the start and texts and rejects of the rounds, both with the place of their
    node, all nodes without texts, and whether ids name one node each; if not, rounds give no places."""
    spark, folder = nodes.sparkSession, work_folder(nodes.sparkSession)
    kind = _kind(*[F.col(c) for c in ("content", "parent_id", "start", "length", "content_chunk_group")])
    text = F.coalesce("content", F.lit(""))
    place, none = ["parent_id", "chunk_group", "idx"], F.lit(None).cast("string").alias("reason")
    most = (F.col("most") if "most" in nodes.columns else F.lit(limit)).alias("most")
    typed = nodes.select("node_id", *place, "start", "length", "content_chunk_group", kind.alias("kind"), most, text.alias("text"), F.length(text).alias("n"))
    if not files:
        # The texts at the start are written once, here; all else is found from the columns beside them.
        typed = written(typed, f"{folder}/nodes")
    shape = stored(typed.drop("text"))
    own_place = shape.select("node_id", *place)
    # Rows carry their place along where a node is one row; where ids repeat, places are looked up by id.
    named = shape.where("node_id IS NOT NULL")
    repeated = lambda key: not stored(named.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")).isEmpty()
    unique = not (repeated(F.xxhash64("node_id")) and repeated(F.col("node_id")))
    groups = shape.where("kind = 'group'").select(F.col("node_id").alias("parent_id"), F.col("content_chunk_group").alias("chunk_group"), "most")
    keys = ["parent_id", "chunk_group"]
    if unique:
        # Rows are counted where they are read, by the group they are in.
        counted = lambda rows, out: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).join(groups.select(*keys), keys).select("parent_id", out)
        needed = stored(counted(shape, "n"))
    else:
        members = stored(groups.join(own_place, keys).select("parent_id", "node_id", "idx"))
        counted = lambda rows, out: members.join(rows.select("node_id"), "node_id", "left_semi").groupBy("parent_id").agg(F.count(F.lit(1)).alias(out))
        needed = members.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    spans = shape.where("kind = 'span'").select("node_id", "parent_id", "start", "length")
    spanned = not spans.isEmpty()
    childless = groups.join(needed, "parent_id", "left_anti").select(F.col("parent_id").alias("node_id"), F.lit("").alias("text"), none)
    columns = ["node_id", "text", "reason", *place, "n"]
    at_start = F.col("kind").isin("own", "empty")
    start = typed.where(at_start).select("node_id", "text", none, *place, "n")
    LOG = ", ".join(f"{c} {start.schema[c].dataType.simpleString()}" for c in columns)
    whole_log = lambda since: spark.read.schema(f"{LOG}, round int").parquet(f"{folder}/log").where(F.col("round") >= since).select(*columns)

    def log(since: int = 0, no: int | None = None, texts: bool = True) -> DataFrame:
        """Texts of the rounds from ``since`` on, or of round ``no``; without ``texts`` all but these."""
        rows = whole_log(since) if no is None else spark.read.schema(LOG).parquet(f"{folder}/log/round={no}")
        first = start if texts else shape.where(at_start).select("node_id", none, *place, "n")
        rows = rows if texts else rows.drop("text")
        return first.unionByName(rows) if not (since if no is None else no) else rows

    def placed(rows: DataFrame) -> DataFrame:
        found = rows.join(own_place, "node_id", "left") if unique else rows.withColumns({c: F.lit(None).cast(start.schema[c].dataType) for c in place})
        return found.withColumn("n", F.length("text")).select(*columns)

    def wholes(no: int) -> DataFrame | None:
        """Texts of the groups whose last open member came in round ``no``."""
        came = counted(log(no=no, texts=False).where("reason IS NULL"), "came")
        written(came, f"{folder}/counts/round={no}")
        counts = spark.read.schema("parent_id string, came long, round int").parquet(f"{folder}/counts")
        so_far = counts.join(counts.where(F.col("round") == no).select("parent_id"), "parent_id", "left_semi").groupBy("parent_id").agg(
            F.sum("came").alias("came"), F.min("round").alias("since"))
        ready = stored(so_far.join(needed.hint("merge"), "parent_id").where("came = n").select("parent_id", "since").join(groups.distinct(), "parent_id"))
        since = ready.agg(F.min("since")).first()[0]
        if since is None:
            return None
        rows = log(since).where("reason IS NULL")
        if not unique:
            texts = members.join(ready.groupBy("parent_id").agg(F.max("most").alias("most")), "parent_id").withColumn("chunk_group", F.lit("")).join(
                rows.select("node_id", "text", "n"), "node_id")
            return placed(concat_ordered(texts, [*keys, "most"], "idx", "text", "", "text", F.col("most"), size="n").select(
                F.col("parent_id").alias("node_id"), "text", F.when(F.col("text").isNull(), F.lit("text_too_long")).alias("reason")))
        # Sizes and places are found apart from the texts, so texts move once, and those of a group too long for a cell not at all.
        sizes = log(since, texts=False).where("reason IS NULL").groupBy(*keys).agg(F.sum("n").alias("n"))
        own = own_place.select(F.col("node_id").alias("parent_id"), F.struct(*place).alias("own"))
        # Ids fill little room in a file, and much in memory: no broadcast by the size of files.
        sized = stored(ready.hint("merge").select(*keys, "most").join(sizes, keys).join(own, "parent_id").select(*keys, "own", (F.col("n") <= F.col("most")).alias("fits")))
        fits, n = sized.where("fits").select(*keys, "own"), sized.where("fits").count()
        found = sized.where("NOT fits").select(F.col("parent_id").alias("node_id"), F.lit(None).cast("string").alias("text"), F.lit("text_too_long").alias("reason"), "own")
        if n:
            texts = rows.select(*keys, "idx", "text").join(small(fits, n) if n <= 10_000 else fits.hint("merge"), keys).repartition(*keys)
            found = found.unionByName(concat_ordered(texts, [*keys, "own"], "idx", "text", "", "text", None).select(F.col("parent_id").alias("node_id"), "text", none, "own"))
        return found.select("node_id", "text", "reason", *[f"own.{c}" for c in place], F.length("text").alias("n"))

    def cuts(no: int) -> DataFrame | None:
        """Texts of the spans of nodes that came in round ``no``."""
        asked = stored(spans.join(log(no=no, texts=False).where("reason IS NULL").select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi"))
        if asked.isEmpty():
            return None
        fresh = log(no=no).where("reason IS NULL").select(F.col("node_id").alias("parent_id"), "text")
        return placed(cut_spans(rope_of_cells(fresh.join(asked.select("parent_id").distinct(), "parent_id", "left_semi"), "parent_id"), asked, ["node_id"], "parent_id").select(
            "node_id", "text", "reason"))

    written(placed(childless), f"{folder}/log/round=0")
    no = 0
    while found := [rows for rows in (cuts(no) if spanned else None, wholes(no)) if rows is not None]:
        no += 1
        written(reduce(DataFrame.unionByName, found), f"{folder}/log/round={no}")
    return start, whole_log(0), shape, unique


# --- combination and order --------------------------------------------------------

def combine_documents(docs: DataFrame, by: str, order_by: str, group_name: str = "sources",
                      master_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One master document per value of ``by``, its members as chunks of ``group_name``.

    Masters and members are keyed by the ``master_id`` column if given, else by the SHA-256 of
    ``by``; the members' ids joined by ``:`` in order stand once, as ``joined_id`` of the master.
    ``order_by`` is numeric. A member that is the only one of its master has the joined id for
    its own and gets ``_child`` appended. Returns (masters, members).
    """
    placed = dense_index(docs, [by], order_by, "chunk_idx")
    key = F.sha2(F.col(by).cast("string"), 256)
    ids = docs.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), (F.min(master_id) if master_id else F.first(key)).alias("master_id"))
    joined = concat_ordered(placed, [by], "chunk_idx", "doc_id", ":", "joined_id")
    masters = ids.join(joined, by, "left").select(by, F.col("master_id").alias("doc_id"), "joined_id", F.lit(group_name).alias("content_chunk_group"))
    if master_id:
        members = placed.drop("master_id").join(ids.select(by, "master_id"), by)
        same = F.col("doc_id") == F.col("master_id")
    else:
        # Only masters of one member take part, so no key is hot on either side that matches.
        alone = ids.where("_n = 1").select(by, F.lit(True).alias("_alone"))
        members = placed.join(alone, by, "left").withColumn("master_id", key)
        same = F.coalesce("_alone", F.lit(False))
    members = members.withColumn("child_id", F.when(same, F.concat("doc_id", F.lit("_child"))).otherwise(F.col("doc_id"))).drop("_alone")
    return masters, members.withColumn("chunk_group", F.lit(group_name))


def member_chunks(members: DataFrame) -> DataFrame:
    """Members of combined documents as chunk rows of their masters."""
    return as_chunks(members.drop("parent", "chunk_id").select(
        F.col("master_id").alias("doc_id"), F.col("child_id").alias("chunk_id"), F.col("master_id").alias("parent"), F.lit(1).alias("depth"),
        *[c for c in members.columns if c not in ("doc_id", "chunk_id", "parent", "depth", "master_id", "child_id")]))


def with_neighbors(chunks: DataFrame, group: str) -> DataFrame:
    """``prev_id`` and ``next_id`` of each chunk of a group, among the chunks of its owner."""
    one = owned(chunks).where(F.col("chunk_group") == group)
    one = with_frames(one, GROUP, "chunk_idx", 1, 1, {
        "prev_id": (F.max("chunk_id"), -1, -1), "next_id": (F.max("chunk_id"), 1, 1)})
    return one


def chunk_group(chunks: DataFrame, group: str) -> DataFrame:
    return chunks.where(F.col("chunk_group") == group)


def replace_group(chunks: DataFrame, group: str, rows: DataFrame) -> DataFrame:
    """Put ``rows`` in place of ``group`` for the nodes they belong to."""
    chunks, rows = owned(chunks), owned(rows)
    old = chunks.join(rows.select("doc_id", "owner").distinct().withColumn("chunk_group", F.lit(group)), GROUP, "left_anti")
    return old.unionByName(rows.withColumn("chunk_group", F.lit(group)), allowMissingColumns=True)


def append_to_group(chunks: DataFrame, group: str, rows: DataFrame) -> DataFrame:
    """Append ``rows`` (dense ``chunk_idx`` of their own) behind the chunks of ``group``."""
    chunks, rows = owned(chunks), owned(rows)
    ends = (chunks.where(F.col("chunk_group") == group).groupBy("doc_id", "owner")
            .agg(F.max("chunk_idx").alias("_end")))
    moved = (rows.withColumn("chunk_group", F.lit(group)).join(ends, ["doc_id", "owner"], "left")
             .withColumn("chunk_idx", (F.col("chunk_idx") + F.coalesce(F.col("_end") + 1, F.lit(0))).cast("int"))
             .drop("_end"))
    return chunks.unionByName(moved, allowMissingColumns=True)


def ensure_group(docs: DataFrame, chunks: DataFrame, group: str = "all") -> DataFrame:
    """Give documents without ``group`` one chunk of their full (resolved) text."""
    have = _own_chunks(chunks).where(F.col("chunk_group") == group).select("doc_id").distinct()
    made = docs.join(have, "doc_id", "left_anti").select(
        "doc_id", F.lit(group).alias("chunk_group"), F.lit(0).alias("chunk_idx"),
        F.concat("doc_id", F.lit(f"/{group}@0")).alias("chunk_id"), F.col("doc_id").alias("parent"),
        F.coalesce("content", F.lit("")).alias("content"), F.lit(1).alias("depth"))
    return as_chunks(chunks).unionByName(as_chunks(made))


# --- extraction ------------------------------------------------------------------

def _block(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def extract_markdown(docs: DataFrame, chunks: DataFrame, include_metadata: bool = False) -> DataFrame:
    """(doc_id, markdown, reason): document text, or its content group's chunks one per
    line, with metadata comments on request. Both sides carry resolved content. Text too
    long for one cell is NULL with a reason; its chunks have it."""
    groups = docs.where(F.col("content_chunk_group").isNotNull()).select(
        "doc_id", F.col("content_chunk_group").alias("chunk_group"))
    # A group name without rows means the document is printed from its own text.
    members = _own_chunks(chunks).join(groups, ["doc_id", "chunk_group"], "left_semi")
    comments = _block(comment_lines(F.col("metadata"))) if include_metadata else F.lit("")
    line = F.concat(F.coalesce(comments, F.lit("")), F.coalesce("content", F.lit("")), F.lit("\n"))
    by_chunk = concat_ordered(members.withColumn("_line", line), ["doc_id"], "chunk_idx", "_line", "", "_md").withColumn("_found", F.lit(True))
    own = F.concat(F.coalesce(comments, F.lit("")), F.coalesce("content", F.lit("")))
    text = F.when(F.col("_found").isNotNull(), F.col("_md")).when(F.col("content").isNotNull(), own)
    return docs.join(by_chunk, "doc_id", "left").select(
        "doc_id", trim_all(text).alias("markdown"), F.when(text.isNull(), F.lit("text_too_long")).alias("reason"))


def extract_summary(docs: DataFrame, field: str = "summary", separator: str = "\n\n--\n\n",
                    pretty: bool = True) -> DataFrame:
    """(doc_id, summary, message): delta arrays joined, an object's delta, another object
    as JSON (indented if ``pretty``), anything else as text."""
    def parts(v, text):
        kind = json_kind(v)
        deltas = F.filter(F.transform(array_texts(text), delta_text), lambda t: trim_all(t) != "")
        plain = (F.when(kind == "ARRAY", F.array_join(deltas, separator))
                 .when((kind == "OBJECT") & json_kind(member(v, "delta")).isNotNull(), annotation(text, "delta"))
                 .when((kind != "OBJECT") & (kind != "VOID"), text))
        whole = F.when((kind == "OBJECT") & json_kind(member(v, "delta")).isNull(), compact(text))
        return F.struct(kind.alias("kind"), plain.alias("plain"), whole.alias("object"))

    found = bind(member(F.try_parse_json("annotations"), field),
                 lambda v: bind(annotation(F.col("annotations"), field), lambda t: parts(v, t)))
    rows = docs.select("doc_id", found.alias("f")).select("doc_id", F.col("f.kind").alias("_kind"), F.col("f.plain").alias("_plain"), F.col("f.object").alias("_object"))
    shown = pretty_json(F.col("_object")) if pretty else F.col("_object")
    return rows.select("doc_id", F.coalesce("_plain", shown).alias("summary"),
                       F.when(F.col("_kind").isNull(), F.lit(f"No {field} found in annotations")).alias("message"))


def chunk_annotations(chunks: DataFrame, group: str, target: str = "summary",
                      include_metadata: bool = False) -> DataFrame:
    """One row per chunk of the group: its annotation as text, NULL where it has none."""
    def text_of(v, text):
        kind = json_kind(v)
        return (F.when(kind == "ARRAY", F.array_join(F.transform(array_texts(text), delta_text), "\n"))
                .when(kind == "VOID", F.lit("null")).when(v.isNotNull(), delta_text(text)))
    value = bind(member(F.try_parse_json("annotations"), target),
                 lambda v: bind(annotation(F.col("annotations"), target), lambda t: text_of(v, t)))
    cols = ["doc_id", "chunk_idx", value.alias("annotation")]
    return chunks.where(F.col("chunk_group") == group).select(*cols, *(["metadata"] if include_metadata else []))


def missing_group(docs: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """Documents that lack the group an operator was asked for."""
    have = _own_chunks(chunks).where(F.col("chunk_group") == group).select("doc_id")
    return docs.join(have, "doc_id", "left_anti").select(
        "doc_id", F.lit(f'Chunk group "{group}" not found in document').alias("reason"))
