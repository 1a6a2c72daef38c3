"""WARC archives: one gzip member for each record, written by tasks and read back sequentially."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import batch_slices, parts, staged
from signalweave.tables import new_path

#: Records with smaller payloads are never revisits.
LEAST = 100
#: A task starts another archive after about this many compressed bytes.
ARCHIVE = 32 << 20
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system and its path there; a path without a scheme is local."""
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+://|file:", folder) else (fs.LocalFileSystem(), folder)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record's bytes, not yet compressed. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}" if "%" not in url else f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~')}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream: BinaryIO, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member of a stream, in order, inflated bit by bit; at most one is held. A member cut short is an error."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(step)
        if not data:
            if out:
                raise ValueError("the archive ends within a record")
            return
        out.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parsed(data: bytes) -> dict:
    """A record's fields, framed by its Content-Length and held against its digests; what does not agree is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(h["content-length"])
    block, end = rest[:size], rest[size:]
    if version != "WARC/1.1" or len(block) != size or end != b"\r\n\r\n":
        raise ValueError(f"bad framing of {h.get('warc-record-id')}")
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != h["warc-block-digest"]:
        raise ValueError(f"bad block digest of {h['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    if h["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"bad payload of {h['warc-record-id']}")
    return {"page_id": _page(h["warc-record-id"]), "url": unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None, "record_type": h["warc-type"], "refers_to": _page(h["warc-refers-to"]) if "warc-refers-to" in h else None, "payload_bytes": length, "payload_digest": digest, "payload": payload if h["warc-type"] == "response" else None}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row under folder and returns the manifest (path, records, bytes), a written table.

    Of records with equal payloads of LEAST bytes or more, that with the smallest page id is the response, others refer
    to it; rows that repeat that smallest id are responses too. Null html is an empty payload; a null id never is the
    smallest unless alone. Only archives in the manifest count: a failed task's leftovers are in no row of it.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest, size = F.sha2(F.col("html").cast("binary"), 256), F.octet_length("html")
    firsts = rows.where(size >= LEAST).groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    rows = rows.withColumn("digest", digest).withColumn("size", size)
    # too small ones get a key of their own: they match nothing and do not meet in one task
    rows = rows.withColumn("key", F.when(F.col("size") >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    rows = rows.join(firsts, F.col("key") == F.col("of"), "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    rows = rows.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "digest", "size", F.when(F.col("revisit"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, path, n, size = None, "", 0, 0
        made: list[tuple[str, int, int]] = []

        for batch in batches:
            for part in batch_slices(batch, "html"):
                for r in part.to_pylist():
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        path, n, size = f"{folder}/{name}", 0, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    data = _member(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["size"], r["refers_to"], r["html"] is None))
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= ARCHIVE:
                        out.close()
                        out = None
                        made.append((path, n, size))
        if out is not None:
            out.close()
            made.append((path, n, size))
        yield pa.record_batch([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "records", "bytes"])

    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    return staged(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of RECORDS from the archives that manifest names; each is read once, from start to end, by one task. Damaged records and wrong counts are errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, _, name = path.rpartition("/")
                store, base = _store(folder)
                held, size, seen = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        held.append(parsed(data) if payloads else parsed(data) | {"payload": None})
                        seen, size = seen + 1, size + (len(data) if payloads else 500)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                if seen != records:
                    raise ValueError(f"{path} holds {seen} records, not {records}")
                yield pa.RecordBatch.from_pylist(held, kinds)

    spread = manifest.select("path", "records").repartition(parts(manifest.sparkSession))
    return spread.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns what reading them gives, without the payloads."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")), payloads=False).drop("payload")
