"""WARC archives of pages: an index first, then coalesced range reads of what is wanted.

Writing. Payload digests decide which record is the response and which revisit it; only ids and
digests meet for that. Pages are then joined with the decisions, and each task writes one ``.warc.gz``
with a gzip member per record and returns the index row of each: file, offset, length, url, digest.
Reading. Index rows of a file are sorted by offset, ranges that (nearly) touch are merged into one
read, each member is inflated and parsed. Payloads are checked against their digests.

Defined cases: a null html is an empty payload; a null url is written as ``urn:page:<id>``; a null id
is smaller than any other and writes ``null`` into the record id; an id may repeat (of equal payloads
under the largest id, each row is a response); an empty table gives an empty result; payloads shorter
than ``least`` bytes are always responses; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.bpe import byte_slices
from docflow.llm.scratch import scratch_dir, staged
from docflow.llm.shards import ShardReader, ShardWriter

DATE = "1970-01-01T00:00:00Z"       # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits are 10 hexadecimal and 8 base-32 digits."""
    hexed = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """Repeated payloads: (digest, response_id), one row for each digest with more than one record."""
    keyed = pages.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("size"))
    return (keyed.where(F.col("size") >= least).groupBy("digest")
            .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    # A revisit keeps the HTTP head and the length of what it leaves out.
    block = HTTP + payload if refers_to is None else HTTP
    head += [("X-Payload-Length", str(len(payload))), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(pages: DataFrame, folder: str, least: int = 0, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Write archives and index below ``folder``; returns the index."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    repeated = staged(record_plan(rows, least), folder, "repeated")
    ids = rows.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("size"))
    revisits = (ids.where(F.col("size") >= least).join(repeated, "digest")
                .where(~F.col("page_id").eqNullSafe(F.col("response_id")))
                .select(F.col("page_id").alias("rid"), F.col("digest").alias("rdigest"), "response_id").distinct())
    decided = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("rid")) & (base32_sha1(F.col("payload")) == F.col("rdigest")),
                        "left").drop("rid", "rdigest")
    # The order of records over files does not matter, so the pages stay where the join has them.
    ordered = decided.sortWithinPartitions("page_id", "payload")
    archives = f"{folder}/archives"
    schema = ordered.select("page_id", "url", *[F.lit(0).cast(kind).alias(name) for name, kind in (
        ("digest", "string"), ("file", "string"), ("offset", "long"), ("length", "long"))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = ShardWriter(archives, TaskContext.get().partitionId(), "warc.gz")
        for batch in batches:
            for s, e in byte_slices(batch.column(2)):
                part, digests, offsets, lengths = batch.slice(s, e - s), [], [], []
                for one_id, one_url, payload, refers in zip(*(c.to_pylist() for c in (
                        part.column(0), part.column(1), part.column(2).cast(pa.binary()), part.column(3)))):
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    member = _member(_record(one_id, one_url, payload, digest, refers))
                    offsets.append(archive.append(member))
                    lengths.append(len(member))
                    digests.append(digest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests, pa.string()), pa.array([archive.name] * len(digests), pa.string()),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=schema.names)
        archive.close()

    return staged(ordered.mapInArrow(run, schema), folder, "index")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[:int(fields["Content-Length"])]


def read_warc(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """Records of the index rows (all, or those given).

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload); the payload of a
    revisit is null, its length and digest are those of the full payload.
    """
    index = spark.read.parquet(f"{folder}/index") if index is None else index
    archives = f"{folder}/archives"
    rows = index.select("page_id", "url", "digest", "file", "offset", "length")
    schema = rows.select("page_id", "url", F.lit(0).cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                         F.lit("").alias("record_type"), F.col("page_id").alias("refers_to"), F.lit(b"").alias("payload")).schema
    for field in schema.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(archives)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                digests, files, offsets, lengths = (part.column(i).to_pylist() for i in (2, 3, 4, 5))
                sizes, kinds, refers, payloads = ([None] * part.num_rows for _ in range(4))
                for name in dict.fromkeys(files):
                    own = sorted((i for i, f in enumerate(files) if f == name), key=offsets.__getitem__)
                    for k, member in reader.ranges(name, [(offsets[i], lengths[i]) for i in own]):
                        i = own[k]
                        fields, block = parse_record(zlib.decompress(member, 31))
                        sizes[i], kinds[i] = int(fields["X-Payload-Length"]), fields["WARC-Type"]
                        if kinds[i] == "response":
                            payloads[i] = block.partition(b"\r\n\r\n")[2]
                            found = base64.b32encode(hashlib.sha1(payloads[i]).digest()).decode()
                        else:
                            refers[i] = fields["WARC-Refers-To"][len("<urn:page:"):-1]
                            found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if found != digests[i] or len(payloads[i] or b"") not in (0, sizes[i]):
                            raise ValueError(f"record at {offsets[i]} of {name} is damaged")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), part.column(2), pa.array(kinds, pa.string()),
                     pa.array(refers, pa.string()).cast(part.column(0).type), pa.array(payloads, pa.binary())], names=schema.names)

    return rows.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def warc_roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages, then read every record back."""
    folder = scratch_dir(pages.sparkSession)
    write_warc(pages, folder, least)
    return read_warc(pages.sparkSession, folder)
