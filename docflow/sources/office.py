"""DOCX and PPTX files. Python only opens the zip and its XML; the rest is DataFrame work."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import trim_end
from docflow.operators.ordering import concat_ordered, running_before

# Namespaces of the office formats.
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW_NS = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHOW_NS = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
ELEMENTS = ("file string, slide string, elem_idx int, type string, text string, rows array<array<string>>, reason string")


def _docx_text(data: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for para in root.iter(f"{WORD_NS}p"):
        for node in para.iter():
            if node.tag == f"{WORD_NS}t":
                out.append(node.text or "")
            elif node.tag == f"{WORD_NS}tab":
                out.append("\t")
            elif node.tag == f"{WORD_NS}br":
                out.append("\f" if node.get(f"{WORD_NS}type") == "page" else "\n")
        out.append("\n\n")
    return "".join(out)


def extract_docx(files: DataFrame) -> DataFrame:
    """Raw text of ``files(path, content)``: (path, text, reason)."""
    def run(batches):
        for pdf in batches:
            texts, reasons = [], []
            for data in pdf.content:
                try:
                    texts.append(_docx_text(data))
                    reasons.append(None)
                except Exception as err:  # encrypted, damaged or unknown: a file that cannot be read is a row
                    texts.append(None)
                    reasons.append(f"unreadable docx: {err}")
            yield pdf[["path"]].assign(text=texts, reason=reasons)
    return files.select("path", "content").mapInPandas(run, "path string, text string, reason string")


def docx_pages(texts: DataFrame) -> DataFrame:
    """Pages of ``texts(doc_id, text, filename)`` at form feeds, ready to assemble."""
    from docflow.operators.convert import page_metadata, split_pages
    pages = split_pages(texts)
    n = (F.col("page_idx") + 1).cast("string")
    line = lambda key, value: F.concat(F.lit(f"<!-- METADATA {key}: "), value, F.lit(" -->\n"))
    return pages.select(
        "doc_id", "page_idx", "text",
        page_metadata(F.col("doc_id"), F.col("page_idx"), F.lit("mammoth"), F.lit(1.0), F.lit(None).cast("string"),
                      F.col("page_idx") == 0, F.col("filename")).alias("metadata"),
        F.concat(line("page_number", n), line("text_extraction_method", F.lit("mammoth")),
                 line("originating_filename", F.coalesce("filename", F.lit("")))).alias("comments"))


def ingest_docx(files: DataFrame, page_numbering: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, chunks, rejects) from registered DOCX files; ``doc_id`` is the file's SHA-256."""
    from docflow.operators.convert import assemble_pages
    from docflow.sources.files import base_name
    texts = extract_docx(files)
    keys = files.select("path", F.sha2("content", 256).alias("doc_id"), base_name(F.col("path")).alias("filename"))
    good = texts.where("reason is null").join(keys, "path").dropDuplicates(["doc_id"])
    docs, chunks = assemble_pages(docx_pages(good.select("doc_id", "text", "filename")), page_numbering)
    return docs, chunks, texts.where("reason is not null").select("path", "reason")


# --- slides ------------------------------------------------------------------------

def _texts(node) -> list[str]:
    return [t.text for t in node.iter(f"{DRAW_NS}t") if t.text]


def _slide_elements(data: bytes) -> list[tuple]:
    archive = zipfile.ZipFile(io.BytesIO(data))
    out = []
    for name in archive.namelist():
        if not re.fullmatch(r"ppt/slides/slide\d+\.xml", name):
            continue
        tree = ElementTree.fromstring(archive.read(name)).find(f"{SHOW_NS}cSld/{SHOW_NS}spTree")
        k = 0
        for shape in (tree.findall(f"{SHOW_NS}sp") if tree is not None else []):
            mark = shape.find(f"{SHOW_NS}nvSpPr/{SHOW_NS}nvPr/{SHOW_NS}ph")
            kind = mark.get("type") if mark is not None else None
            body = shape.find(f"{SHOW_NS}txBody")
            words = _texts(body) if body is not None else []
            if words:
                # Placeholder types.
                typ = {"title": "title", "ctrTitle": "title", "subTitle": "subtitle", "body": "body"}.get(kind, "text")
                out.append((name, k, typ, "\n".join(words).strip(), None))
                k += 1
        for frame in (tree.findall(f"{SHOW_NS}graphicFrame") if tree is not None else []):
            grid = frame.find(f"{DRAW_NS}graphic/{DRAW_NS}graphicData/{DRAW_NS}tbl")
            rows = [[" ".join(_texts(c)).strip() for c in r.findall(f"{DRAW_NS}tc")]
                    for r in (grid.findall(f"{DRAW_NS}tr") if grid is not None else [])]
            rows = [r for r in rows if r]
            if rows:
                out.append((name, k, "table", None, rows))
                k += 1
        if k == 0:
            out.append((name, 0, "none", None, None))
    return out


def extract_slides(files: DataFrame) -> DataFrame:
    """Typed elements of every slide of ``files(path, content)``."""
    def run(batches):
        import pandas as pd
        names = [c.split()[0] for c in ELEMENTS.split(", ")]
        for pdf in batches:
            for path, data in zip(pdf.path, pdf.content):
                try:
                    rows = [(path, *e, None) for e in _slide_elements(data)]
                except Exception as err:  # a file that cannot be read is a row
                    rows = [(path, None, 0, "none", None, None, f"unreadable pptx: {err}")]
                yield pd.DataFrame(rows, columns=names)
    return files.select("path", "content").mapInPandas(run, ELEMENTS)


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a table; short rows are padded, the first row is the header."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    padded = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.concat(padded[0], rule, F.array_join(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), ""))


def render_slides(elements: DataFrame) -> DataFrame:
    """(file, markdown, reason): slides by number, each element under its type comment. A file too long for one
    cell has no markdown but reason ``text_too_long``."""
    number = F.coalesce(F.regexp_extract("slide", r"slide(\d+)", 1).cast("int"), F.lit(0))
    numbered = elements.withColumn("_no", number)
    ends = numbered.groupBy("file", "_no").agg(F.max("elem_idx").alias("_last"))
    text = F.when(F.col("type") == "table", markdown_table(F.col("rows"))).otherwise(F.col("text"))
    head = F.when(F.col("type") == "title", "## ").when(F.col("type") == "subtitle", "### ").otherwise("")
    rule = F.when(F.col("type").isin("body", "text") & (F.col("elem_idx") < F.col("_last")), "---\n\n").otherwise("")
    block = F.when(F.col("type") == "none", F.lit("")).otherwise(
        F.concat(F.lit("<!-- TYPE: "), "type", F.lit(" -->\n"), head, text, F.lit("\n\n"), rule))
    body = concat_ordered(numbered.join(ends, ["file", "_no"]).withColumn("_block", block),
                          ["file", "_no"], "elem_idx", "_block", "", "_body")
    # Slides are renumbered from one in the order of their file numbers.
    position = running_before(ends.select("file", "_no"), ["file"], "_no", {"_pos": F.lit(1)})
    slide = F.concat(trim_end(F.concat(F.lit("<!-- SLIDE: "), (F.col("_pos") + 1).cast("string"), F.lit(" -->\n\n"), "_body")), F.lit("\n"))
    whole = concat_ordered(body.join(position, ["file", "_no"]).withColumn("_slide", slide),
                           ["file"], "_pos", "_slide", "\n---\n---\n\n", "_md")
    return whole.select("file", F.regexp_replace("_md", "(?m)^• ", " - ").alias("markdown"),
                        F.when(F.col("_md").isNull(), F.lit("text_too_long")).alias("reason"))


def ingest_pptx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(markdown per file, rejects)."""
    elements = extract_slides(files)
    return (render_slides(elements.where("reason is null")),
            elements.where("reason is not null").select(F.col("file").alias("path"), "reason"))
