"""Queries: page tables, routing, failures, assembly, reconciliation, slides."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import convert as V
from docflow.operators import reconcile as R
from docflow.sources.office import docx_pages, render_slides
from docflow.workload.inputs import SQL_LINES, documents, lines
from docflow.workload.registry import query, table


def _ocr(spark, sf):
    """Lines as OCR pages. Confidence, replies and errors derive from position and labels."""
    page = lines(spark, sf).select("doc_id", F.col("chunk_idx").alias("page_idx"), F.col("content").alias("ocr_text"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")
    joined = page.join(labels, "doc_id", "left")
    base = (F.col("page_idx") * 37 + F.col("doc_id").cast("long") * 11) % 100
    conf = F.when(F.col("quality") == 0, base / 200).otherwise(base / 100)
    quoted = F.to_json(F.struct(F.concat(F.lit("V:"), F.col("ocr_text")).alias("markdown"),
                                (F.col("page_idx") % 3 == 0).alias("isFirstPage"),
                                F.concat(F.lit("page "), F.col("page_idx").cast("string")).alias("description"),
                                F.array(F.lit("scan")).alias("tags")))
    reply = (F.when(F.col("page_idx") % 5 == 4, F.concat(F.lit("V:"), F.col("ocr_text")))
             .when(F.col("page_idx") % 5 == 3, F.concat(F.lit("```json\n"), quoted, F.lit("\n```"))).otherwise(quoted))
    return joined.select("doc_id", "page_idx", "ocr_text", conf.alias("ocr_confidence"), reply.alias("vision_reply"), "toxic")


_SQL_OCR = f"""{SQL_LINES}, ocr AS (
  SELECT l.doc_id, idx, txt, (idx * 37 + CAST(l.doc_id AS BIGINT) * 11) % 100
    / (CASE WHEN quality = 0 THEN 200.0::DOUBLE ELSE 100.0::DOUBLE END) AS conf, toxic
  FROM lines l LEFT JOIN labels b ON l.doc_id = CAST(b.doc_id AS VARCHAR))"""
_SQL_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _route_sql(detect: bool) -> str:
    used = "TRUE" if detect else "conf < 0.7"
    seen = "(conf < 0.7 OR idx > 0)" if detect else "conf < 0.7"
    return f"""WITH {_SQL_OCR}
SELECT doc_id, CAST(idx AS BIGINT) AS page_idx,
  CASE WHEN conf < 0.7 THEN 'vision_model' ELSE 'ocr' END AS method,
  CASE WHEN conf < 0.7 THEN round(greatest(conf, 0.9), 3) ELSE round(conf, 3) END AS confidence,
  CASE WHEN idx = 0 THEN TRUE WHEN {used} THEN idx % 5 <> 4 AND idx % 3 = 0 ELSE FALSE END AS is_first_page,
  sha256(CASE WHEN conf < 0.7 THEN (CASE WHEN idx % 5 = 4 THEN {_SQL_TRIM.format("'V:' || txt")} ELSE 'V:' || txt END)
              ELSE txt END) AS text_hash,
  CASE WHEN {seen} AND idx % 5 <> 4 THEN 'page ' || idx END AS description,
  CASE WHEN {seen} AND idx % 5 <> 4 THEN 'scan' END AS tags FROM ocr"""


def _routed(df):
    return df.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), "method", "confidence", "is_first_page",
                     F.sha2("text", 256).alias("text_hash"), "description", F.array_join("tags", ",").alias("tags"))


@query("route_pages", _route_sql(False))
def _(spark, sf):
    pages = _ocr(spark, sf).withColumn("vision_reply", F.when(V.needs_model(), F.col("vision_reply")))
    return _routed(V.route_pages(pages, model="m"))


@query("route_pages_boundaries", _route_sql(True))
def _(spark, sf):
    pages = _ocr(spark, sf).withColumn("vision_reply", F.when(V.needs_model(detect_boundaries=True), F.col("vision_reply")))
    return _routed(V.route_pages(pages, detect_boundaries=True, model="m"))


@query("normalize_vision_reply", f"""WITH {_SQL_OCR}
SELECT doc_id, CAST(idx AS BIGINT) AS page_idx,
  sha256(CASE WHEN idx % 5 = 4 THEN {_SQL_TRIM.format("'V:' || txt")} ELSE 'V:' || txt END) AS markdown_hash,
  idx % 5 <> 4 AND idx % 3 = 0 AS is_first_page, CASE WHEN idx % 5 <> 4 THEN 'page ' || idx ELSE '' END AS description
FROM ocr""")
def _(spark, sf):
    r = _ocr(spark, sf).withColumn("r", V.normalize_vision_reply(F.col("vision_reply")))
    return r.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.sha2("r.markdown", 256).alias("markdown_hash"),
                    F.col("r.is_first_page").alias("is_first_page"), F.col("r.description").alias("description"))


def _failed():
    return (F.col("toxic") == 1) & (F.col("page_idx") % 4 == 1)


@query("page_failure_rollup", f"""WITH {_SQL_OCR}, f AS (SELECT doc_id, coalesce(toxic = 1 AND idx % 4 = 1, FALSE) AS failed FROM ocr)
SELECT doc_id, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS pages_failed,
  CAST(count(*) FILTER (WHERE NOT failed) AS BIGINT) AS pages_successful,
  CASE WHEN bool_or(failed) THEN 'partial' END AS transcription_status FROM f GROUP BY doc_id""")
def _(spark, sf):
    return V.page_failure_rollup(_ocr(spark, sf), F.coalesce(_failed(), F.lit(False)))


@query("failure_policy", f"""WITH {_SQL_OCR},
f AS (SELECT doc_id, idx, coalesce(toxic = 1 AND idx % 4 = 1, FALSE) AS failed, CAST(doc_id AS BIGINT) % 2 = 0 AS filtered FROM ocr),
d AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE failed) AS failed, bool_or(failed AND NOT filtered) AS fatal FROM f GROUP BY doc_id)
SELECT doc_id, CASE WHEN fatal THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'complete' END AS transcription_status,
  CAST(CASE WHEN fatal THEN total ELSE failed END AS BIGINT) AS pages_failed,
  CAST(CASE WHEN fatal THEN 0 ELSE total - failed END AS BIGINT) AS pages_successful,
  CAST(CASE WHEN fatal THEN 1 ELSE total END AS BIGINT) AS page_chunks FROM d""")
def _(spark, sf):
    kind = F.when(F.col("doc_id").cast("long") % 2 == 0, "content_filter_violation").otherwise("rate_limit")
    error = F.when(_failed(), F.struct(F.lit("Error").alias("name"), F.lit("page refused").alias("message"), kind.alias("interpreted_type")))
    pages = V.route_pages(_ocr(spark, sf), model="m").withColumn("vision_error", error)
    ready, status = V.apply_failure_policy(pages, True, model="m", at="2024-01-01T00:00:00.000Z")
    docs, chunks = V.assemble_pages(ready)
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_chunks"))
    return status.join(n, "doc_id").select("doc_id", "transcription_status", "pages_failed",
                                           F.col("pages_successful").cast("long").alias("pages_successful"), "page_chunks")


_TAGS = {"the": "the", "und": "und", "digit": "1", "at": "@"}


@query("tag_by_substring", """
SELECT page_id, array_to_string(list_filter([CASE WHEN contains(html, 'the') THEN 'the' END, CASE WHEN contains(html, 'und') THEN 'und' END,
  CASE WHEN contains(html, '1') THEN 'digit' END, CASE WHEN contains(html, '@') THEN 'at' END], lambda x: x IS NOT NULL), ',') AS tags FROM pages""")
def _(spark, sf):
    return V.tag_by_substring(table(spark, sf, "pages"), _TAGS, "html").select("page_id", F.array_join("tags", ",").alias("tags"))


@query("vision_prompts", f"""WITH {_SQL_OCR}, p AS (SELECT *, CASE WHEN idx % 3 <> 1 THEN idx END AS img FROM ocr),
q AS (SELECT *, max(img) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p)
SELECT doc_id, CAST(idx AS BIGINT) AS page_idx, CAST(prev AS BIGINT) AS preceding_idx, sha256(concat_ws(chr(10) || chr(10),
  'Transcribe the page image into well-structured markdown, word for word, and decide whether it starts a new document. Keep tables as markdown tables where possible.',
  'Document description: a scan', CASE WHEN txt <> '' THEN 'Markdown of the preceding page:' || chr(10) || txt END,
  CASE WHEN prev IS NOT NULL THEN 'The image of a preceding page is provided besides the current page.' END,
  'Add a "description" of one to three sentences.',
  'Answer with raw JSON only: "markdown", "isFirstPage", optional "description", "tags".')) AS prompt_hash FROM q""")
def _(spark, sf):
    pages = _ocr(spark, sf).withColumn("preceding_content", F.col("ocr_text")).withColumn(
        "image_url", F.when(F.col("page_idx") % 3 != 1, F.concat(F.lit("img:"), F.col("page_idx").cast("string"))))
    out = V.vision_prompts(pages, description="a scan", preceding=True)
    return out.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.col("preceding_idx").cast("long").alias("preceding_idx"),
                      F.sha2("user", 256).alias("prompt_hash"))


_SQL_META = """'<!-- METADATA page_number: ' || (idx + 1) || ' -->' || chr(10) || '<!-- METADATA text_extraction_method: ' || method || ' -->'
  || chr(10) || '<!-- METADATA originating_filename: f' || doc_id || '.docx -->' || chr(10)"""

_SQL_PAGES = f"""{SQL_LINES}, t AS (SELECT doc_id, idx, {_SQL_TRIM.format('txt')} AS txt, 'mammoth' AS method FROM lines),
c AS (SELECT doc_id, idx, txt, {_SQL_META} || txt AS content FROM t)"""


@query("page_split", f"""WITH {SQL_LINES} SELECT doc_id, CAST(idx AS BIGINT) AS page_idx, sha256({_SQL_TRIM.format('txt')}) AS text_hash FROM lines""")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.regexp_replace("content", "\n", "\f").alias("text"))
    return V.split_pages(docs).select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.sha2("text", 256).alias("text_hash"))


def _docx(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.regexp_replace("content", "\n", "\f").alias("text"),
                                       F.concat(F.lit("f"), "doc_id", F.lit(".docx")).alias("filename"))
    return V.assemble_pages(docx_pages(docs))


@query("assemble_pages", f"""WITH {_SQL_PAGES}
SELECT doc_id || '/pages@' || idx AS chunk_id, CAST(coalesce(sum(length(txt)) OVER w, 0) AS BIGINT) AS start, CAST(length(txt) AS BIGINT) AS length,
  CAST(coalesce(sum(length(content) + 26) OVER w, 0) AS BIGINT) AS content_start, sha256(content) AS content_hash
FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    _, chunks = _docx(spark, sf)
    return chunks.select("chunk_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"),
                         "content_start", F.sha2("content", 256).alias("content_hash"))


@query("assemble_pages_text", f"""WITH {_SQL_PAGES}
SELECT doc_id, sha256(string_agg(content, chr(10) || chr(10) || '<!-- page boundary -->' || chr(10) || chr(10) ORDER BY idx)) AS content_hash
FROM c GROUP BY doc_id""")
def _(spark, sf):
    docs, _ = _docx(spark, sf)
    return docs.select("doc_id", F.sha2("content", 256).alias("content_hash"))


@query("slide_markdown", f"""WITH {SQL_LINES}, e AS (
  SELECT doc_id, idx // 4 AS slide, idx % 4 AS k, idx,
    CASE idx % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'subtitle' WHEN 2 THEN 'body' ELSE 'table' END AS type,
    CASE idx % 4 WHEN 2 THEN '• ' || txt WHEN 3 THEN
      '| ' || txt || ' |  |' || chr(10) || '| --- | --- |' || chr(10) || '| a | b |' || chr(10) ELSE txt END AS text,
    row_number() OVER (PARTITION BY doc_id, idx // 4 ORDER BY idx) = count(*) OVER (PARTITION BY doc_id, idx // 4) AS is_last FROM lines),
r AS (SELECT doc_id, slide, regexp_replace('<!-- SLIDE: ' || (slide + 1) || ' -->' || chr(10) || chr(10) || string_agg(
    '<!-- TYPE: ' || type || ' -->' || chr(10) || CASE type WHEN 'title' THEN '## ' WHEN 'subtitle' THEN '### ' ELSE '' END || text
    || chr(10) || chr(10) || CASE WHEN type = 'body' AND NOT is_last THEN '---' || chr(10) || chr(10) ELSE '' END, '' ORDER BY k), '\\s+$', '') || chr(10) AS md
  FROM e GROUP BY doc_id, slide)
SELECT doc_id, sha256(regexp_replace(string_agg(md, chr(10) || '---' || chr(10) || '---' || chr(10) || chr(10) ORDER BY slide), '(?m)^• ', ' - ', 'g')) AS md_hash
FROM r GROUP BY doc_id""")
def _(spark, sf):
    k = F.col("chunk_idx") % 4
    typ = F.when(k == 0, "title").when(k == 1, "subtitle").when(k == 2, "body").otherwise("table")
    cells = F.when(k == 3, F.array(F.array(F.col("content")), F.array(F.lit("a"), F.lit("b"))))
    elements = lines(spark, sf).select(
        F.col("doc_id").alias("file"), F.concat(F.lit("ppt/slides/slide"), (F.floor(F.col("chunk_idx") / 4) * 3 + 2).cast("string"),
                                               F.lit(".xml")).alias("slide"), k.alias("elem_idx"), typ.alias("type"),
        F.when(k == 2, F.concat(F.lit("• "), "content")).when(k < 2, F.col("content")).alias("text"), cells.alias("rows"))
    return render_slides(elements).select(F.col("file").alias("doc_id"), F.sha2("markdown", 256).alias("md_hash"))


def _pairs(spark, sf):
    """Two readings per document: every second document misreads one syllable."""
    misread = F.replace(F.replace("content", F.lit("the"), F.lit("tbe")), F.lit("The"), F.lit("Tbe"))
    return documents(spark, sf).select(F.col("doc_id").alias("pair_id"), F.col("content").alias("text_a"), F.when(
        F.col("doc_id").cast("long") % 2 == 1, misread).otherwise(F.col("content")).alias("text_b"))


# Misread words never occur in the other reading, so the alignment is positional.
_SQL_PAIRS = r"""p AS (SELECT CAST(doc_id AS VARCHAR) AS pair_id, text AS a,
    CASE WHEN doc_id % 2 = 1 THEN replace(replace(text, 'the', 'tbe'), 'The', 'Tbe') ELSE text END AS b FROM documents),
w AS (SELECT pair_id, list_transform(regexp_extract_all(a, '[^ \t\n\r\f]+'), lambda x: lower(regexp_replace(x, '[`‘’]', '''', 'g'))) AS ta,
    list_transform(regexp_extract_all(b, '[^ \t\n\r\f]+'), lambda x: lower(regexp_replace(x, '[`‘’]', '''', 'g'))) AS tb,
    lower(regexp_extract(a, '[^ \t\n\r\f]([^ \t\n\r\f]*[ \t\n\r\f]*)$', 1)) = lower(regexp_extract(b, '[^ \t\n\r\f]([^ \t\n\r\f]*[ \t\n\r\f]*)$', 1)) AS tail FROM p),
m AS (SELECT pair_id, unnest(range(len(ta) + 1)) AS pos, unnest(list_append(list_transform(range(1, len(ta) + 1), lambda i: ta[i] = tb[i]), tail)) AS same FROM w),
g AS (SELECT *, sum(CASE WHEN same IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY pos) AS island
      FROM (SELECT *, lag(same) OVER (PARTITION BY pair_id ORDER BY pos) AS prev FROM m)),
i AS (SELECT pair_id, island, same, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT pair_id, island, 0 AS sub, 'MATCH' AS op, n FROM i WHERE same
      UNION ALL SELECT pair_id, island, 0, 'DELETE', n FROM i WHERE NOT same UNION ALL SELECT pair_id, island, 1, 'INSERT', n FROM i WHERE NOT same)"""


@query("reconcile_runs", f"""WITH {_SQL_PAIRS}
SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY island, sub) - 1 AS BIGINT) AS run_idx, op, CAST(n AS BIGINT) AS n FROM r""")
def _(spark, sf):
    return R.reconcile_runs(_pairs(spark, sf)).select("pair_id", F.col("run_idx").cast("long").alias("run_idx"), "op", "n")


@query("disagreement_stats", f"""WITH {_SQL_PAIRS}, s AS (SELECT pair_id, coalesce(sum(n) FILTER (WHERE op = 'MATCH'), 0) AS matched,
  coalesce(sum(n) FILTER (WHERE op = 'DELETE'), 0) AS deleted, coalesce(sum(n) FILTER (WHERE op = 'INSERT'), 0) AS inserted FROM r GROUP BY pair_id)
SELECT pair_id, CAST(matched AS BIGINT) AS matched, CAST(deleted AS BIGINT) AS deleted, CAST(inserted AS BIGINT) AS inserted,
  round(CAST(deleted + inserted AS DOUBLE) / greatest(matched + deleted + inserted, 1), 6) AS disagreement FROM s""")
def _(spark, sf):
    return R.disagreement_stats(R.reconcile_runs(_pairs(spark, sf)))


@query("reconcile_markup", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS t, strpos(text, ' ') AS p, length(text) - strpos(reverse(text), ' ') + 1 AS q FROM documents)
SELECT id AS pair_id, sha256(CASE WHEN p = 0 THEN t ELSE left(t, p) || '<ocr var="0">Gone' || id || ' </ocr>' || substr(t, p + 1, q - p) ||
  '<ocr var="1">New' || id || ' </ocr>' || substr(t, q + 1) END) AS markup_hash,
  CAST(CASE WHEN p = 0 THEN 0 ELSE 1 END AS BIGINT) AS deleted, CAST(CASE WHEN p = 0 THEN 0 ELSE 1 END AS BIGINT) AS inserted FROM d""")
def _(spark, sf):
    """One reading has a word more behind the first space, the other one behind the last."""
    t, i = F.col("content"), F.col("doc_id")
    p, q = F.locate(" ", t), F.length(t) - F.locate(" ", F.reverse(t)) + 1
    put = lambda at, word: F.when(F.locate(" ", t) == 0, t).otherwise(
        F.concat(F.substr(t, F.lit(1), at), F.lit(word), i, F.lit(" "), F.substr(t, at + 1)))
    pairs = documents(spark, sf).select(i.alias("pair_id"), put(p, "Gone").alias("text_a"), put(q, "New").alias("text_b"))
    runs = R.reconcile_runs(pairs)
    stats = R.disagreement_stats(runs).select("pair_id", "deleted", "inserted")
    return R.render_markup(runs).join(stats, "pair_id").select("pair_id", F.sha2("markup", 256).alias("markup_hash"), "deleted", "inserted")
