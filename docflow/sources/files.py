"""Files and raw content into tables."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.dataurl import decode_data_url, encode_data_url, sniff_image

# Extensions read as text, and those of text attachments.
TEXT_EXTENSIONS = (".txt", ".md", ".py", ".js", ".java", ".c", ".cpp", ".cs", ".rb", ".go", ".rs", ".php",
                   ".html", ".css", ".json", ".xml", ".sh", ".bat")
ATTACHMENT_EXTENSIONS = (".txt", ".md", ".py", ".js", ".json", ".csv")
DOCX_MIME = "officedocument.wordprocessingml.document"


def wrap_documents(df: DataFrame, content: str) -> DataFrame:
    """Add ``doc_id`` (SHA-256 of the content) and ``content``; objects become JSON text."""
    typ = dict(df.dtypes)[content]
    text = F.col(content) if typ == "string" else F.to_json(content)
    kept = [c for c in df.columns if c not in (content, "doc_id", "content")]
    return df.select(*kept, F.sha2(text, 256).alias("doc_id"), text.alias("content"))


def register_files(files: DataFrame) -> DataFrame:
    """Hash and size of ``files(path, content binary, mimetype)``; only PDF and DOCX are accepted."""
    mime = F.lower("mimetype")
    ok = F.coalesce(mime.contains("pdf") | mime.contains(DOCX_MIME), F.lit(False))
    return files.withColumn("document_sha256", F.sha2("content", 256)).withColumn(
        "size_bytes", F.octet_length("content").cast("long")).withColumn("accepted", ok).withColumn(
        "reason", F.when(~ok, F.lit("Currently only PDF or DOCX are supported.")))


def decode_uploads(df: DataFrame, url: str = "pdf_dataurl") -> DataFrame:
    """Inline PDF uploads to bytes; anything but a base64 PDF data URL is rejected."""
    ok = F.coalesce(F.col(url).startswith("data:application/pdf;base64,"), F.lit(False))
    return df.withColumn("content", F.when(ok, decode_data_url(F.col(url))["content"])).withColumn(
        "mimetype", F.when(ok, F.lit("application/pdf"))).withColumn(
        "reason", F.when(~ok, F.lit("pdf_dataurl must be data:application/pdf;base64,...")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of the files below a folder; hidden and empty ones are left out, as Spark does.

    Tasks list the folders and read the files, so the driver holds no names: one task lists the folder itself, others what
    is below its entries. Patterns, single files and stores that pyarrow cannot open go through Spark's own listing.
    """
    folder = _folder(spark, path)
    return _spark_files(spark, path) if folder is None else _contents(_listed(spark, folder), folder)


def read_text_files(spark: SparkSession, path: str, extensions: Sequence[str] = TEXT_EXTENSIONS) -> DataFrame:
    """(path, text) of files on the allow-list; ``.doc.json`` files belong to read_docs."""
    wanted = extension(F.col("path")).isin(*extensions) & ~F.lower("path").endswith(".doc.json")
    folder = _folder(spark, path)
    files = _spark_files(spark, path).where(wanted) if folder is None else _contents(_listed(spark, folder).where(wanted), folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, reason): images as data URLs, text files as document parts."""
    files = read_binary(spark, path)
    mime, ext = sniff_image(F.col("content")), extension(F.col("path"))
    text = ext.isin(*ATTACHMENT_EXTENSIONS)
    null = F.lit(None).cast("string")
    part = F.when(mime.isNotNull(), _part("image", url=encode_data_url(F.col("content"), mime))).when(
        text, _part("document", filename=base_name(F.col("path")), text=F.decode("content", "UTF-8")))
    reason = F.when(mime.isNull() & ~text, F.concat(F.lit("Unsupported file type: "), ext)).otherwise(null)
    return files.select("path", part.alias("part"), reason.alias("reason"))


def _part(kind: str, **fields: Column) -> Column:
    from docflow.operators.transcripts import part
    return part(kind, **fields)


def _spark_files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "content", "length"))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and the folder within it; local names are taken as they are, without escapes."""
    return (fs.LocalFileSystem(), folder[5:]) if folder.startswith("file:") else fs.FileSystem.from_uri(folder)


def _folder(spark: SparkSession, path: str) -> str | None:
    """The path of a folder as Spark names it, with its scheme; None if it is none that tasks can list."""
    if not isinstance(path, str) or any(c in path for c in "*?[]{}\\"):
        return None
    if ":/" not in path:
        home = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
        path = f"file:{os.path.abspath(path)}" if home.startswith("file:") else f"{home.rstrip('/')}/{path.lstrip('/')}" if path.startswith("/") else path
    if path.startswith("file:/"):
        path = f"file:/{os.path.normpath(path[5:]).lstrip('/')}"
    path = path.rstrip("/")
    try:
        store, top = _store(path)
        return path if path.endswith(top) and store.get_file_info(top).type == fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None


def _hidden(file: fs.FileInfo) -> bool:
    """Names that Spark's listing passes over; of its folders of metadata only the files."""
    name = file.base_name
    if file.type == fs.FileType.Directory and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files below a folder."""
    def lister(deep: bool):
        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None]]:
            store, top = _store(folder)
            prefix = folder[:len(folder) - len(top)]
            for batch in batches:
                for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                    if length is not None:
                        yield path, length
                        continue
                    left = [path[len(prefix):]]
                    while left:
                        for file in store.get_file_info(fs.FileSelector(left.pop())):
                            if _hidden(file):
                                continue
                            if file.type == fs.FileType.File and file.size:
                                yield prefix + file.path, file.size
                            elif file.type == fs.FileType.Directory and deep:
                                left.append(file.path)
                            elif file.type == fs.FileType.Directory:
                                yield prefix + file.path, None
        return lambda batches: _batches(entries(batches), pa.schema([("path", pa.string()), ("length", pa.int64())]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("path"), F.lit(None).cast("long").alias("length"))
    some = top.mapInArrow(lister(False), "path string, length long").repartition(n, "path")
    return some.mapInArrow(lister(True), "path string, length long").repartition(n, "path")


def _contents(files: DataFrame, folder: str) -> DataFrame:
    """(path, content, length) of ``files(path, length)``, which are below ``folder``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
        store, top = _store(folder)
        skip = len(folder) - len(top)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path[skip:]) as file:
                    content = file.read()
                yield path, content, len(content)

    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("length", pa.int64())])
    return files.mapInArrow(lambda batches: _batches(read(batches), schema), "path string, content binary, length long")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 4 MB."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 100 + (len(row[1]) if isinstance(row[1], bytes) else 0)
        if size > 4_000_000:
            yield _batch(some, schema)
            some, size = [], 0
    if some:
        yield _batch(some, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
