"""Queries: wrapping, content, extraction, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions.dataurl import decode_data_url, encode_data_url
from docflow.functions.jsonx import delta_text, parse_reply, reply_json
from docflow.functions.text import fence_length, redact, token_count
from docflow.operators import content as C
from docflow.operators.validate import POSITIVE_INT, REQUIRED, split_valid
from docflow.schemas import as_chunks, as_docs
from docflow.sources.files import register_files, wrap_documents
from docflow.session import kept
from docflow.sinks.documents import PART, nest_docs
from docflow.sources.docjson import parse_docs
from docflow.workload.inputs import SQL_LINES, documents, lines, nested, sql_count
from docflow.workload.registry import query, table


@query("wrap_documents", """
SELECT CAST(doc_id AS VARCHAR) AS source_id, sha256(text) AS doc_id, CAST(length(text) AS BIGINT) AS n_chars
FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "source_id")
    return wrap_documents(docs, "text").select(F.col("source_id").cast("string").alias("source_id"), "doc_id",
                                               F.length("content").cast("long").alias("n_chars"))


@query("register_files", """
SELECT url AS path, sha256(html) AS document_sha256, CAST(strlen(html) AS BIGINT) AS size_bytes,
  contains(lower(CASE page_id % 3 WHEN 0 THEN 'application/pdf'
       WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
       ELSE 'text/html' END), 'pdf') OR page_id % 3 = 1 AS accepted
FROM pages""")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    mime = (F.when(F.col("page_id") % 3 == 0, "application/pdf")
            .when(F.col("page_id") % 3 == 1,
                  "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("text/html"))
    files = pages.select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), mime.alias("mimetype"))
    return register_files(files).select("path", "document_sha256", "size_bytes", "accepted")


@query("data_url_roundtrip", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CAST(length('data:text/plain;base64,' || base64(encode(text))) AS BIGINT) AS url_len,
  sha256('data:text/plain;base64,' || base64(encode(text))) AS url_hash, TRUE AS same FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("u", encode_data_url(F.encode("text", "UTF-8"), "text/plain"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.length("u").cast("long").alias("url_len"),
                       F.sha2("u", 256).alias("url_hash"),
                       (F.decode(decode_data_url(F.col("u"))["content"], "UTF-8") == F.col("text")).alias("same"))


@query("token_count", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST({sql_count('text')} AS BIGINT) AS n_tokens FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"),
                                                token_count(F.col("text")).cast("long").alias("n_tokens"))


def _spans(spark, sf):
    """Lines as spans of their document, one in seven past its end."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.split("text", "\n", -1).alias("s"))
    sizes = F.transform("s", lambda t: F.length(t))
    at = F.aggregate(sizes, F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<start:int,length:int>>").alias("out")), lambda a, n: F.struct(
        (a["p"] + n + 1).alias("p"), F.concat(a["out"], F.array(F.struct(a["p"].alias("start"), n.alias("length")))).alias("out")))["out"]
    rows = docs.select("doc_id", F.size("s").alias("n"), F.posexplode(at).alias("chunk_idx", "x"))
    bad = (F.col("chunk_idx") == F.col("n") - 1) & (F.col("doc_id").cast("long") % 7 == 0)
    return as_chunks(rows.select("doc_id", F.lit("spans").alias("chunk_group"), "chunk_idx",
                                 F.concat("doc_id", F.lit("/spans@"), F.col("chunk_idx").cast("string")).alias("chunk_id"),
                                 F.col("x.start").alias("start"), (F.col("x.length") + bad.cast("int")).alias("length"),
                                 F.lit(1).alias("depth")))


@query("resolve_spans", f"""
WITH {SQL_LINES}
SELECT doc_id || '/spans@' || idx AS chunk_id,
  CASE WHEN idx = n - 1 AND CAST(doc_id AS BIGINT) % 7 = 0 THEN NULL ELSE sha256(txt) END AS content_hash,
  CASE WHEN idx = n - 1 AND CAST(doc_id AS BIGINT) % 7 = 0 THEN 'span_out_of_range' END AS reason
FROM lines""")
def _(spark, sf):
    _, spans = C.resolve_content(documents(spark, sf), _spans(spark, sf))
    return spans.select("chunk_id", F.sha2("content", 256).alias("content_hash"), "reason")


@query("resolve_groups", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(replace(text, chr(10), '')) AS content_hash FROM documents""")
def _(spark, sf):
    docs = documents(spark, sf).withColumn("content", F.lit(None).cast("string")).withColumn(
        "content_chunk_group", F.lit("lines"))
    whole = C.resolve_docs(docs, lines(spark, sf))
    return whole.select("doc_id", F.sha2("content", 256).alias("content_hash"))


@query("resolve_nested", f"""
WITH {SQL_LINES}
SELECT doc_id AS node_id, sha256(string_agg(txt, '' ORDER BY idx)) AS content_hash FROM lines GROUP BY doc_id
UNION ALL SELECT doc_id || '/' || idx // 4, sha256(string_agg(txt, '' ORDER BY idx)) FROM lines GROUP BY doc_id, idx // 4
UNION ALL SELECT doc_id || '/lines@' || idx, sha256(txt) FROM lines
UNION ALL SELECT doc_id || '/head', sha256(substr(string_agg(txt, '' ORDER BY idx), 1, least(5, sum(length(txt)))::BIGINT))
FROM lines GROUP BY doc_id""")
def _(spark, sf):
    # Document = parts of four lines each, every level assembled from the one below, and a
    # span over the head of the assembled document.
    leaf = lines(spark, sf)
    part = F.floor(F.col("chunk_idx") / 4).cast("int")
    no_int, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    leaves = leaf.select(F.col("chunk_id").alias("node_id"), F.concat("doc_id", F.lit("/"), part.cast("string")).alias("parent_id"),
                         F.lit("lines").alias("chunk_group"), (F.col("chunk_idx") % 4).alias("idx"), "content",
                         no_int.alias("start"), no_int.alias("length"), no_text.alias("content_chunk_group"))
    parts = leaf.groupBy("doc_id", part.alias("idx")).agg(F.lit(1)).select(
        F.concat("doc_id", F.lit("/"), F.col("idx").cast("string")).alias("node_id"), F.col("doc_id").alias("parent_id"),
        F.lit("parts").alias("chunk_group"), "idx", no_text.alias("content"), no_int.alias("start"),
        no_int.alias("length"), F.lit("lines").alias("content_chunk_group"))
    tops = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("node_id"), no_text.alias("parent_id"), no_text.alias("chunk_group"),
        no_int.alias("idx"), no_text.alias("content"), no_int.alias("start"), no_int.alias("length"),
        F.lit("parts").alias("content_chunk_group"))
    size = F.length(F.regexp_replace("text", "\n", ""))
    heads = table(spark, sf, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("/head")).alias("node_id"), F.col("doc_id").cast("string").alias("parent_id"),
        F.lit("heads").alias("chunk_group"), F.lit(0).alias("idx"), no_text.alias("content"), F.lit(0).alias("start"),
        F.least(F.lit(5), size).alias("length"), no_text.alias("content_chunk_group"))
    texts, _ = C.resolve_nested(leaves.unionByName(parts).unionByName(tops).unionByName(heads))
    return texts.select("node_id", F.sha2("text", 256).alias("content_hash"))


@query("combine_documents", """
WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS k, source FROM documents),
m AS (SELECT source, string_agg(id, ':' ORDER BY k) AS joined_id FROM o GROUP BY source)
SELECT sha256(o.source) AS master_id, CASE WHEN id = m.joined_id THEN id || '_child' ELSE id END AS child_id,
  CAST(row_number() OVER (PARTITION BY o.source ORDER BY k) - 1 AS BIGINT) AS idx
FROM o JOIN m USING (source)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"), "source")
    _, members = C.combine_documents(docs, "source", "n")
    return members.select("master_id", "child_id", F.col("chunk_idx").cast("long").alias("idx"))


@query("nest_roundtrip", """
WITH d AS (SELECT source, doc_id, CAST(doc_id AS VARCHAR) AS id, replace(text, chr(10), '') AS t,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT sha256(source) AS doc_id, CASE WHEN n = 1 THEN id || '_child' ELSE id END AS node, CAST(i AS BIGINT) AS idx, sha256(t) AS content_hash FROM d
UNION ALL SELECT sha256(source), NULL, NULL, sha256(string_agg(t, '' ORDER BY doc_id)) FROM d GROUP BY source""")
def _(spark, sf):
    """Masters of documents of lines, written as document objects, read back and resolved at all levels."""
    # The texts lie in the files of one step at a time, and of the next one while it is made.
    objects = kept(lambda: [nest_docs(*nested(spark, sf), part=PART).where("json IS NOT NULL").select("json")])
    parsed = kept(lambda: parse_docs(objects[0])[:2])
    objects.drop()

    def resolved():
        docs, chunks = C.resolve_content(*parsed, doc_limit=PART, files=True)
        return docs.select("doc_id", "content", "content_chunk_group", "reason"), chunks.where("chunk_group = 'sources'")

    # Read twice below, as members and as the texts of their masters.
    texts = kept(resolved)
    parsed.drop()

    def hashes():
        docs, chunks = texts
        tops = docs.where("reason IS NULL").select("doc_id", F.sha2("content", 256).alias("content_hash")).unionByName(
            C.text_sha256(docs.where("reason = 'text_too_long'"), chunks).withColumnRenamed("sha256", "content_hash"))
        yield chunks.select("doc_id", F.col("chunk_id").alias("node"), F.col("chunk_idx").cast("long").alias("idx"), F.sha2("content", 256).alias("content_hash")).unionByName(
            tops.select("doc_id", F.lit(None).cast("string").alias("node"), F.lit(None).cast("long").alias("idx"), "content_hash"))

    found = kept(hashes)
    texts.drop()
    return found[0]


@query("combine_masters", """
SELECT source, sha256(source) AS doc_id, sha256(string_agg(CAST(doc_id AS VARCHAR), ':' ORDER BY doc_id)) AS joined_hash FROM documents GROUP BY source""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"), "source")
    masters, _ = C.combine_documents(docs, "source", "n")
    return masters.select("source", "doc_id", F.sha2("joined_id", 256).alias("joined_hash"))


@query("chunk_neighbors", f"""
WITH {SQL_LINES}, ids AS (SELECT doc_id, idx, doc_id || '/lines@' || idx AS chunk_id FROM lines)
SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id
FROM ids WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def _(spark, sf):
    return C.with_neighbors(lines(spark, sf).select("doc_id", "chunk_group", "chunk_idx", "chunk_id"), "lines").select(
        "chunk_id", "prev_id", "next_id")


@query("group_ops", f"""
WITH {SQL_LINES}
SELECT doc_id, 'lines' AS chunk_group, CAST(idx AS BIGINT) AS idx, doc_id || '/lines@' || idx AS chunk_id FROM lines
UNION ALL SELECT doc_id, 'lines', CAST(n + idx // 2 AS BIGINT), doc_id || '/lines@' || idx FROM lines WHERE idx % 2 = 0
UNION ALL SELECT doc_id, 'odd', CAST(idx // 2 AS BIGINT), doc_id || '/lines@' || idx FROM lines WHERE idx % 2 = 1""")
def _(spark, sf):
    # Append every second line to its group again; replace group `odd` by the other lines.
    base = lines(spark, sf).select("doc_id", "chunk_group", "chunk_idx", "chunk_id")
    half = F.floor(F.col("chunk_idx") / 2).cast("int")
    even = base.where("chunk_idx % 2 = 0").withColumn("chunk_idx", half)
    odd = base.where("chunk_idx % 2 = 1").withColumn("chunk_idx", half)
    stale = base.where("chunk_idx % 2 = 1").withColumn("chunk_group", F.lit("odd"))
    grown = C.append_to_group(base.unionByName(stale), "lines", even)
    return C.replace_group(grown, "odd", odd).select("doc_id", "chunk_group", F.col("chunk_idx").cast("long").alias("idx"), "chunk_id")


@query("ensure_group", f"""
WITH {SQL_LINES}
SELECT doc_id, 'lines' AS chunk_group, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(txt)) AS BIGINT) AS chars FROM lines
WHERE lang = 'en' GROUP BY doc_id
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'lines', 1, CAST(length(text) AS BIGINT) FROM documents WHERE lang <> 'en'""")
def _(spark, sf):
    english = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"))
    have = lines(spark, sf).join(english, "doc_id", "left_semi")
    full = C.ensure_group(documents(spark, sf), have, "lines")
    return full.groupBy("doc_id", "chunk_group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("extract_markdown", f"""
WITH {SQL_LINES}, md AS (
  SELECT doc_id, string_agg('<!-- line: ' || idx || ' -->' || chr(10) || '<!-- lang: ' || lang || ' -->' || chr(10)
                            || txt || chr(10), '' ORDER BY idx) AS t FROM lines WHERE lang = 'en' GROUP BY doc_id
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR), '<!-- lang: ' || lang || ' -->' || chr(10) || '<!-- source: ' || source || ' -->' || chr(10) || text
  FROM documents WHERE lang <> 'en')
SELECT doc_id, sha256(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS md_hash FROM md""")
def _(spark, sf):
    langs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    docs = documents(spark, sf, metadata=True).join(langs, "doc_id").withColumn(
        "content_chunk_group", F.when(F.col("lang") == "en", "lines"))
    out = C.extract_markdown(docs, lines(spark, sf, metadata=True), include_metadata=True)
    return out.select("doc_id", F.sha2("markdown", 256).alias("md_hash"))


def _annotated(spark, sf):
    """Documents with a summary annotation in each of its shapes."""
    docs = table(spark, sf, "documents")
    head = F.regexp_replace("text", "\n", " ")
    kind = F.col("doc_id") % 6
    obj = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    summary = (F.when(kind == 0, F.to_json(F.array(obj(delta=head), F.lit(" "), F.lit("plain text"), obj(other=head))))
               .when(kind == 1, obj(delta=head)).when(kind == 2, obj(lang=F.col("lang"), head=head))
               .when(kind == 3, F.concat(F.lit('"'), F.col("lang"), F.lit('"'))).when(kind == 4, F.lit("7")))
    ann = F.when(kind == 5, F.lit('{"note":"none"}')).otherwise(F.concat(F.lit('{"note":1,"summary":'), summary, F.lit("}")))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), head.alias("head"), "lang", ann.alias("annotations"))


_SQL_HEAD = """d AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS doc_id, lang,
  replace(text, chr(10), ' ') AS head FROM documents)"""


@query("extract_summary", f"""
WITH {_SQL_HEAD}
SELECT doc_id, CASE k % 6
    WHEN 0 THEN sha256(CASE WHEN trim(head) = '' THEN '' ELSE head || chr(10) || chr(10) || '--' || chr(10) || chr(10) END
      || 'plain text' || chr(10) || chr(10) || '--' || chr(10) || chr(10) || '{{"other":' || to_json(head) || '}}')
    WHEN 1 THEN sha256(head) WHEN 2 THEN sha256('{{"lang":' || to_json(lang) || ',"head":' || to_json(head) || '}}')
    WHEN 3 THEN sha256(lang) WHEN 4 THEN sha256('7') END AS summary_hash,
  CASE WHEN k % 6 = 5 THEN 'No summary found in annotations' END AS message
FROM d""")
def _(spark, sf):
    out = C.extract_summary(as_docs(_annotated(spark, sf)), pretty=False)
    return out.select("doc_id", F.sha2("summary", 256).alias("summary_hash"), "message")


@query("chunk_annotations", f"""
WITH {_SQL_HEAD}
SELECT doc_id, CASE k % 6
    WHEN 0 THEN sha256(head || chr(10) || ' ' || chr(10) || 'plain text' || chr(10) || '{{"other":' || to_json(head) || '}}')
    WHEN 1 THEN sha256(head) WHEN 2 THEN sha256('{{"lang":' || to_json(lang) || ',"head":' || to_json(head) || '}}')
    WHEN 3 THEN sha256(lang) WHEN 4 THEN sha256('7') END AS annotation_hash FROM d""")
def _(spark, sf):
    one = as_chunks(_annotated(spark, sf).withColumn("chunk_group", F.lit("all")).withColumn("chunk_idx", F.lit(0)))
    return C.chunk_annotations(one, "all").select("doc_id", F.sha2("annotation", 256).alias("annotation_hash"))


@query("delta_text", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 4 AS kind, text AS t FROM documents)
SELECT doc_id, sha256(CASE kind WHEN 2 THEN '{"x":' || to_json(t) || '}' ELSE t END) AS text_hash FROM d""")
def _(spark, sf):
    t = F.col("text")
    kind = F.col("doc_id") % 4
    quoted = F.to_json(F.array(t))
    item = (F.when(kind == 0, F.to_json(F.struct(t.alias("delta"))))
            .when(kind == 1, F.substring(quoted, F.lit(2), F.length(quoted) - 2))
            .when(kind == 2, F.concat(F.lit("{ "), F.substr(F.to_json(F.struct(t.alias("x"))), F.lit(2))))
            .otherwise(t))
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"),
                                                F.sha2(delta_text(item), 256).alias("text_hash"))


@query("split_valid", """
SELECT CASE WHEN event_type = 'view' THEN 'document is required'
            WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AND event_type = 'click'
              THEN 'chunk_size must be a positive integer' ELSE 'ok' END AS reason,
  CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    requests = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("user_id")).alias("document"),
        F.when((F.col("event_type") == "click") & (k < 50), -k).otherwise(k + 1).alias("chunk_size"))
    good, bad = split_valid(requests, [REQUIRED("document"), POSITIVE_INT("chunk_size")])
    reasons = bad.select("reason").unionByName(good.select(F.lit("ok").alias("reason")))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("parse_reply", """
SELECT event_id, event_id % 5 <> 0 AS ok,
  CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 5 = 0 THEN 'not json: ' || props END AS raw_text FROM events""")
def _(spark, sf):
    reply = (F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("not json: "), "props"))
             .when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
             .when(F.col("event_id") % 5 == 2, F.concat(F.lit("  "), "props", F.lit("\n"))).otherwise(F.col("props")))
    parsed = parse_reply(reply)
    return table(spark, sf, "events").select(
        "event_id", reply_json(reply).isNotNull().alias("ok"), F.get_json_object(parsed, "$.k").cast("long").alias("k"),
        F.get_json_object(parsed, "$.raw_text").alias("raw_text"))


@query("redact", """
SELECT page_id, sha256(CASE WHEN length(url) > 200 THEN substr(url, 1, 200) || '...[truncated]' ELSE url END) AS url_hash,
  sha256(CASE WHEN page_id % 4 = 0 THEN '[DATA_URL length=' || length('data:image/png;base64,' || html) || ']'
    WHEN length(html) > 200 THEN substr(html, 1, 200) || '...[truncated]' ELSE html END) AS html_hash FROM pages""")
def _(spark, sf):
    pages = table(spark, sf, "pages").withColumn(
        "html", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("data:image/png;base64,"), "html")).otherwise(F.col("html")))
    return redact(pages).select("page_id", F.sha2("url", 256).alias("url_hash"), F.sha2("html", 256).alias("html_hash"))


@query("fence_attachment", f"""
WITH {SQL_LINES}, f AS (SELECT doc_id, idx, CASE WHEN idx % 9 = 4 THEN repeat('`', (idx % 7)::BIGINT) || txt ELSE txt END AS t FROM lines)
SELECT doc_id, CAST(greatest(3, max(length(regexp_extract(t, '(`+)', 1)))) + 1 AS BIGINT) AS fence_len FROM f GROUP BY doc_id""")
def _(spark, sf):
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda t, i: F.when(
        i % 9 == 4, F.concat(F.repeat(F.lit("`"), i % 7), t)).otherwise(t)), "\n")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"),
                                                fence_length(marked).cast("long").alias("fence_len"))
