"""WARC archives: writing, normalising whole-file gzip to a member a record, and reading back through an offset index.

* ``write_archives``: rows become records; a task streams them into archives of about ``ARCHIVE_BYTES`` of text, each one gzip stream
  over the whole file.  Of records with equal payloads the one with the largest id is the response, the others are revisits without payload.
* ``normalise``: each archive is inflated once, in pieces, and rewritten with every record as its own gzip member; a sidecar
  ``.idx`` file of JSON lines beside it and the returned table hold offset, length and the main headers of each record.
* ``read_records``: records are fetched by offset, one member each.

Files are written under names of their own attempt and listed in a stored table by the attempt that succeeded, so a task that is repeated
after a lost executor leaves no second copy in the result.  All of them lie below the shared folder.

Defined results: null content is an empty payload; a null id is the smallest, and written as an empty one; rows that share the largest id of a payload
are all responses; control characters, spaces and non-ASCII in a URL are percent-encoded in its header; an empty table gives no archives and no rows.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, work_path

ARCHIVE_BYTES = 32 * 1024 * 1024
PIECE = 1 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
INDEX = "archive string, offset long, length long, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string"


def _local(uri: str) -> str | None:
    parts = urllib.parse.urlsplit(uri)
    return urllib.parse.unquote(parts.path) if parts.scheme in ("", "file") else None


def put(uri: str, data: bytes) -> None:
    """Write a whole file; it appears under its name only when complete."""
    path = _local(uri)
    if path is None:
        fs, at = pafs.FileSystem.from_uri(uri)
        with fs.open_output_stream(at) as f:
            f.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)


def open_at(uri: str):
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    fs, at = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(at)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, date: str, of: int | None = None) -> bytes:
    """One record; ``of`` is the id of the response that a revisit refers to."""
    name = lambda n: f"<{URN}{'' if n is None else n}>"
    body = HTTP_HEAD + (payload if of is None else b"")
    head = [("WARC-Type", "response" if of is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date),
            ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("X-Payload-Length", len(payload)),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if of is not None:
        head += [("WARC-Refers-To", name(of)), ("WARC-Profile", PROFILE)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Text of a gzip file of one or more members, piece by piece."""
    d = zlib.decompressobj(wbits=31)
    for piece in pieces:
        while piece:
            yield d.decompress(piece)
            piece = b""
            if d.eof:
                piece, d = d.unused_data, zlib.decompressobj(wbits=31)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a text that comes in pieces; only the record at hand is kept."""
    held, need = bytearray(), 0
    for piece in pieces:
        held += piece
        while len(held) >= max(need, 1):
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = next(line for line in bytes(held[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
                need = end + 4 + int(size.split(b":")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("an archive ends within a record")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0,
                   date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records) of the files written: each one gzip stream of many records."""
    folder = work_path(pages.sparkSession, "warc-whole")
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"))
    shared = (rows.filter(F.octet_length("body") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select(F.col("digest").alias("d"), "response"))
    told = rows.join(shared, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), 0
        squeeze, out, size, n = None, io.BytesIO(), 0, 0

        def close() -> pa.RecordBatch:
            out.write(squeeze.flush())
            name = f"{folder}/whole-{task.partitionId():06d}-{task.attemptNumber()}-{made:05d}-{uuid.uuid4().hex[:8]}.warc.gz"
            put(name, out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["archive", "records"])

        for batch in batches:
            for page_id, url, text, of in zip(*(c.to_pylist() for c in batch.columns)):
                if squeeze is None:
                    squeeze, out, size, n = zlib.compressobj(6, zlib.DEFLATED, 31), io.BytesIO(), 0, 0
                raw = record(page_id, url, text.encode(), date, of)
                out.write(squeeze.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    yield close()
                    squeeze, made = None, made + 1
        if squeeze is not None:
            yield close()

    return stored(told.mapInArrow(run, "archive string, records long"), "warc-list")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each listed archive (column ``archive``) with a member a record; returns the index of the new files (``INDEX``)."""
    folder = work_path(archives.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().attemptNumber()
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name = f"{folder}/{os.path.basename(source).removesuffix('.warc.gz')}-{attempt}-{uuid.uuid4().hex[:8]}.warc.gz"
                out, rows = io.BytesIO(), []
                with open_at(source) as f:
                    for raw in split_records(inflated(iter(lambda: f.read(PIECE), b""))):
                        at, head = out.tell(), parse(raw)[0]
                        out.write(gzip.compress(raw, 6, mtime=0))
                        rows.append({"archive": name, "offset": at, "length": out.tell() - at, "record_id": head["WARC-Record-ID"][1:-1], "record_type": head["WARC-Type"],
                                     "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(head["X-Payload-Length"]),
                                     "refers_to": head.get("WARC-Refers-To", "<>")[1:-1] or None})
                put(name, out.getvalue())
                put(name.removesuffix(".warc.gz") + ".idx", "".join(json.dumps(r) + "\n" for r in rows).encode())
                for s in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[s : s + 5000], schema)

    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
                        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string())])
    dealt = archives.repartition(archives.sparkSession.sparkContext.defaultParallelism * 2, F.xxhash64("archive"))
    return stored(dealt.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Fetch every indexed record by its offset: page_id, record_type, refers_to, payload_bytes, payload_digest, payload.

    A response's digest and size are those of the payload read; a revisit has those that its header states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn.removeprefix(URN)) if urn and urn != URN else None
        for batch in batches:
            last, f, rows = None, None, []
            for archive, at, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != last:
                    if f:
                        f.close()
                    last, f = archive, open_at(archive)
                f.seek(at)
                head, body = parse(gzip.decompress(f.read(size)))
                response = head["WARC-Type"] == "response"
                payload = body.partition(b"\r\n\r\n")[2] if response else None
                rows.append({"page_id": number(head["WARC-Record-ID"][1:-1]), "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To", "<>")[1:-1]),
                             "payload_bytes": len(payload) if response else int(head["X-Payload-Length"]),
                             "payload_digest": sha1_base32(payload) if response else head["WARC-Payload-Digest"].removeprefix("sha1:"),
                             "payload": payload.decode() if response else None})
                if sum(len(r["payload"] or "") for r in rows[-1:]) > PIECE or len(rows) >= 200:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if f:
                f.close()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.string())])
    return index.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string")
