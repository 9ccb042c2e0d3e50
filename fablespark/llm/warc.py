"""WARC archives whose records are compressed one by one with an embedded Zstandard dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the
records of that file; every record is one frame compressed with it, so records can be read alone.
Records with equal payloads are written once as `response`, the one with the largest page_id; the
others become `revisit` records that refer to it.

Files are rolled at FILE_BYTES of records, and each is written under a temporary name and renamed,
so a task that is run again replaces its files with the same bytes. Folders are opened through
pyarrow's file systems by URI.

Edge cases: a null html is an empty payload; a page longer than FILE_BYTES ends its file; repeated page_ids are all written, and every row
with the largest page_id of its payload is a response; a null page_id neither refers nor is
referred to; a payload below min_payload bytes is never a revisit; an empty table writes no
file and reads back as no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import qualified
from .common import bounded, in_arrow, shared_dir, staged

DICTIONARY_MAGIC = 0x184D2A5D
FILE_BYTES = 1 << 24
DICTIONARY_BYTES = 1 << 14
SAMPLE_BYTES = 1 << 19
LEVEL = 3
READ_BYTES = 1 << 11
DATE = "2024-01-01T00:00:00Z"  # records carry no wall clock: the same rows give the same bytes


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from an even spread of records; of their raw bytes where they are too few to train on."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


def archive(records: list[bytes]) -> Iterator[bytes]:
    raw = dictionary(records)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    for r in records:
        yield compress.compress(r)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and body of each record of an archive.

    A frame is fed to its decompressor in pieces that grow from READ_BYTES, so what lies behind it is looked at only
    once, however many records a file holds.
    """
    view, at, raw = memoryview(data), 0, b""
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        raw, at = bytes(view[8 : 8 + size]), 8 + size
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    while at < len(view):
        one, parts, step = expand.decompressobj(), [], READ_BYTES
        while not one.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + step]
            parts.append(one.decompress(piece))
            at, step = at + len(piece), 2 * step
        at -= len(one.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        yield fields, rest[: int(fields["content-length"])]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Write pages as archives into folder; rows (file, records, bytes) for what was written."""
    folder = qualified(pages.sparkSession, folder)  # the place that Spark itself takes for it, also for a path without a scheme
    full = F.coalesce(F.col("html"), F.lit(""))
    rows = bounded(pages).select(F.col("page_id").cast("long"), "url", full.alias("html"))
    digests = staged(rows.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("size")), "digests")
    eligible = digests.where(F.col("size") >= min_payload)
    repeated = staged(eligible.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "response"), "repeats")
    marks = eligible.join(repeated, "digest").where("page_id <> response").select("page_id", "digest", "response").distinct()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, held, size, out = TaskContext.get().partitionId(), 0, [], 0, []
        files, root = _filesystem(folder)

        def close():
            nonlocal part, held, size
            name = f"{root}/part-{task:06d}-{part:04d}.warc.zst"
            temporary = f"{root}/.{uuid.uuid4().hex}"
            total = 0
            with files.open_output_stream(temporary) as stream:
                for frame in archive(held):
                    total += stream.write(frame) or len(frame)
            files.move(temporary, name)
            out.append((name.rsplit("/", 1)[-1], len(held), total))
            part, held, size = part + 1, [], 0

        files.create_dir(root, recursive=True)
        for batch in batches:
            for page, url, html, digest, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                bare = base64.b32encode(bytes.fromhex(digest)).decode()
                held.append(record(page, url, payload, bare, response))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return (
        rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
        .join(marks, ["page_id", "digest"], "left")
        .select("page_id", "url", "html", "digest", "response")
        .transform(in_arrow, write, "file string, records long, bytes long")
    )


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    page = lambda urn: None if (x := urn.removeprefix("<urn:page:").removesuffix(">")) == "None" else int(x)
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for head, body in records_of(content.as_py()):
                kind, digest, length = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                if kind == "response":
                    found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if (found, len(body)) != (digest, length):
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                refers = page(head["warc-refers-to"]) if kind == "revisit" else None
                rows.append((page(head["warc-record-id"]), head["warc-target-uri"], kind, length, digest, refers, body if payloads else None))
                size += len(body) * payloads
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in folder, digests of responses verified; payload is null without payloads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("content").transform(in_arrow, lambda batches: _read(batches, payloads), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fable-warc-{uuid.uuid4().hex}"
