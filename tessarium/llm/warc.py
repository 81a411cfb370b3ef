"""WARC archives of pages: writing with revisit records, and a sequential reader.

Every record is a gzip member of its own. The reader takes one member at a time with incremental decompression, frames the block by
Content-Length, and verifies the block's and the payload's digests. Archives are written by tasks through Arrow's file systems,
so the folder may be local, shared or a store that Arrow knows; a file's name is unique to the attempt, and only files of
successful attempts are read, so lost executors and repeated attempts leave nothing behind in the results.

Of pages with equal payloads of at least ``least`` bytes, that with the smallest page_id is the response and the others revisit it. Rows that
repeat this page_id are responses too. A null html is an empty payload; a null page_id orders after all others; a null url
gives no target. An empty table gives no records. Other columns don't matter. A record that isn't framed, has no length or fails its
digests raises BadRecord and ends the job: a reader that went on could not know where the next record begins.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import checkpointed, map_arrow, rows, shared_folder, stored, with_hot

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One date for all records keeps archives the same from run to run.
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class BadRecord(ValueError):
    """A record that isn't framed or doesn't hold what its headers say."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member. A revisit keeps the HTTP head alone, which tells the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (b"" if kind == "revisit" else payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a stream, in order."""
    rest, unpack, out = b"", None, []
    while True:
        data = rest or stream.read(CHUNK)
        if not data:
            if unpack is not None:
                raise BadRecord("the archive ends inside a record")
            return
        unpack = unpack or zlib.decompressobj(31)
        try:
            out.append(unpack.decompress(data))
        except zlib.error as error:
            raise BadRecord(f"no gzip member: {error}") from error
        rest = b""
        if unpack.eof:
            yield b"".join(out)
            rest, unpack, out = unpack.unused_data, None, []


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block, checked against lengths and digests."""
    head, found, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not found or not version.startswith("WARC/"):
        raise BadRecord("no record begins here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise BadRecord("a record without Content-Length or WARC-Type")
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise BadRecord("the block isn't as long as Content-Length says")
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise BadRecord("the block doesn't match its digest")
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers:
        if headers["warc-payload-digest"] != f"sha1:{digest(block.partition(b'\r\n\r\n')[2])}":
            raise BadRecord("the payload doesn't match its digest")
    return headers, block


def page_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(name) if name.lstrip("-").isdigit() else None


def folder(spark, path: str | None) -> str:
    """A new folder below the given one, or below the shared checkpoint folder."""
    base = path or shared_folder(spark)
    return f"{base.rstrip('/')}/warc-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Write archives; a table of their files: file, n_records."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # two hashes: the first is the join's key, the second is compared besides, as with_hot() needs a long one
    digest = F.unhex(F.sha2("html", 256))
    pages = pages.withColumn("key", F.xxhash64(digest)).withColumn("whole", digest)
    first = pages.groupBy("key", "whole").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct("whole", "first")).alias("of"))
    dealt = with_hot(pages, stored(first), "key", "n", ("of",)).withColumn("first", F.get(F.filter("of", lambda x: x["whole"] == F.col("whole")), F.lit(0))["first"])
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()) & (F.octet_length("html") >= least)
    dealt = dealt.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))
    target = folder(pages.sparkSession, path)
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = n = None
        for batch in batches:
            for page, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    files, base = opened(target)
                    files.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n = files.open_output_stream(f"{base}/{name}", compression=None), 0
                out.write(record("response" if refers_to is None else "revisit", f"urn:page:{page}", url, html.encode(), f"urn:page:{refers_to}"))
                n += 1
        if out is not None:
            out.close()
            yield rows(schema, [f"{target}/{name}"], [n])

    return checkpointed(map_arrow(dealt, run, "file string, n_records long"))


def read(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null for revisits) of every record."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                source, path = opened(uri)
                with source.open_input_stream(path, compression=None) as stream:
                    out: list[tuple] = []
                    held = 0
                    for member in members(stream):
                        headers, block = parsed(member)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
                        kind = headers["warc-type"]
                        out.append((page_of(headers["warc-record-id"]), int(http["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:"), kind, page_of(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload if kind == "response" else None))
                        held += len(payload)
                        if held > 8 << 20 or len(out) >= 1024:
                            yield rows(schema, *zip(*out))
                            out, held = [], 0
                    if out:
                        yield rows(schema, *zip(*out))

    return map_arrow(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
