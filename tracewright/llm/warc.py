"""WARC archives as a chunked record table.

Writing: each task streams its pages into one archive in the shared folder, every
record a gzip member of its own; payloads go out in chunks. A page whose payload
an earlier page has becomes a revisit record without payload. Reading: archives
are streamed into rows of record and chunk number, each with the running length
and, in the last chunk, the digest of the payload, so no task holds a whole
record however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import small_batches, written
from tracewright.session import shared_dir

#: Bytes of one chunk row.
CHUNK = 1 << 20
_READ = 1 << 18
_LEVEL = 3
_PLAIN = re.compile(r"[\r\n]+")

RECORDS = ("archive string, record long, page string, uri string, type string, refers_to string, "
           "chunk int, last boolean, data binary, bytes long, payload_bytes long, payload_digest string")


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_head(page: str, uri: str, kind: str, refers: str | None, length: int, sha1: str) -> bytes:
    """Headers of a record and of its HTTP answer. Length and digest are those of the full payload, for revisits too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page)}>", f"WARC-Page-ID: {page}",
             f"WARC-Target-URI: {_PLAIN.sub(' ', uri)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (length if kind == 'response' else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(page, uri, payload, refers, sha1) -> the path of the archive, which gets its name when it is complete."""
    system, root = _opened(folder)
    part = f"{root}/{uuid.uuid4().hex}"
    out, n = None, 0
    for batch in batches:
        if out is None and batch.num_rows:
            system.create_dir(root, recursive=True)
            out = system.open_output_stream(f"{part}.tmp", compression=None)
        pages, uris, refers, sha1 = (batch.column(c).to_pylist() for c in ("page", "uri", "refers", "sha1"))
        for page, uri, payload, first, sha in zip(pages, uris, batch.column("payload"), refers, sha1):
            body = payload.as_buffer()
            kind = "response" if first is None else "revisit"
            pack = zlib.compressobj(_LEVEL, wbits=31)
            out.write(pack.compress(record_head(page, uri, kind, first, 0 if body is None else body.size, digest(bytes.fromhex(sha)))))
            if kind == "response" and body is not None:
                view = memoryview(body)
                for i in range(0, len(view), CHUNK):
                    out.write(pack.compress(view[i : i + CHUNK]))
            out.write(pack.compress(b"\r\n\r\n") + pack.flush())
            n += 1
    if out is not None:
        out.close()
        system.move(f"{part}.tmp", f"{part}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([f"{part}.warc.gz"]), pa.array([n], pa.int64())], ["archive", "records"])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write every page as a record; ``(archive, records)`` of the archives, in a table of the shared folder.

    Of equal payloads of at least ``least`` bytes the page with the smallest id is written in full and the others revisit
    it; shorter payloads are all written. A null payload is empty, a null url an empty string. Rows that repeat an id and
    its payload are each written in full; a null id comes last and is written as ``null``.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    page = F.col(f"`{id_col}`")
    rows = small_batches(pages).select(page.alias("id"), F.coalesce(page.cast("string"), F.lit("null")).alias("page"),
                                       F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("uri"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    owners = rows.filter(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    owners = written(owners.select("sha1", "first"), "owners")
    again = rows.select("id", "sha1").join(owners, "sha1").filter(~F.col("id").eqNullSafe(F.col("first")))
    again = written(again.select("id", F.col("sha1").alias("of"), F.col("first").cast("string").alias("refers")).distinct(), "revisits")
    marked = rows.join(again.hint("merge"), rows["id"].eqNullSafe(again["id"]) & (rows["sha1"] == again["of"]), "left")
    folder = f"{shared_dir(pages.sparkSession)}/{pages.sparkSession.sparkContext.applicationId}/warc-{uuid.uuid4().hex[:8]}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    made = marked.select("page", "uri", "payload", "refers", "sha1").mapInArrow(lambda it: _write(it, folder), "archive string, records long")
    return written(made.withColumn("folder", F.lit(folder)), "archives")


class _Source:
    """Bytes of an archive, decompressed step by step; reads lines and exact amounts."""

    def __init__(self, stream):
        self.stream, self.unzip, self.left, self.buffer = stream, None, b"", bytearray()

    def more(self) -> bool:
        while True:
            if self.unzip is None or self.unzip.eof:
                raw = (self.unzip.unused_data if self.unzip else b"") or self.stream.read(_READ)
                if not raw:
                    return False
                self.unzip = zlib.decompressobj(wbits=31)
            else:
                raw = self.unzip.unconsumed_tail or self.stream.read(_READ)
                if not raw:
                    raise EOFError("the archive ends inside a record")
            got = self.unzip.decompress(raw, _READ)
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        while (i := self.buffer.find(b"\r\n")) < 0:
            if not self.more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + 2]
        return out

    def heads(self) -> dict[str, str] | None:
        first = self.line()
        while first == b"":
            first = self.line()
        if first is None:
            return None
        out = {"": first.decode()}
        while line := self.line():
            name, _, value = line.decode().partition(":")
            out[name.lower()] = value.strip()
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _records(stream) -> Iterator[dict]:
    """Chunk rows of one archive. The digest is carried from chunk to chunk and given with the last one."""
    source, number = _Source(stream), 0
    while (head := source.heads()) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head['']!r}")
        http = source.heads()
        length, sha1, done, chunk = int(http["content-length"]), hashlib.sha1(), 0, 0
        base = {"record": number, "page": head["warc-page-id"], "uri": head.get("warc-target-uri", ""), "type": head["warc-type"], "refers_to": head.get("warc-refers-to-page")}
        if head["warc-type"] == "revisit":
            yield base | {"chunk": 0, "last": True, "data": b"", "bytes": 0, "payload_bytes": length, "payload_digest": head["warc-payload-digest"].partition(":")[2]}
        else:
            while True:
                data = source.take(min(CHUNK, length - done))
                if not data and done < length:
                    raise EOFError("a payload is cut short")
                sha1.update(data)
                done += len(data)
                last = done == length
                yield base | {"chunk": chunk, "last": last, "data": data, "bytes": done, "payload_bytes": length if last else None,
                              "payload_digest": digest(sha1.digest()) if last else None}
                chunk += 1
                if last:
                    break
            if base64.b32encode(sha1.digest()).decode() != head["warc-payload-digest"].partition(":")[2]:
                raise ValueError(f"page {head['warc-page-id']}: the payload does not match its digest")
        number += 1


def _read(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, folder in zip(batch.column("archive").to_pylist(), batch.column("folder").to_pylist()):
            system, _ = _opened(folder)
            with system.open_input_stream(archive, compression=None) as stream:
                rows, size = [], 0
                for row in _records(stream):
                    size += len(row["data"]) + 500
                    rows.append({"archive": archive, **row} if "data" in columns else {"archive": archive, **row, "data": None})
                    if size >= 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], schema)


def read_archives(archives: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chunk rows (``RECORDS``) of the archives; name the columns that are wanted, to leave the payload behind.

    A record of up to CHUNK bytes is one row, a longer one several, in order of ``chunk``. Digest and length of the payload
    stand in the row that is ``last``. A payload that does not match the digest it was written with raises an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(RECORDS)
    names = columns or kinds.fieldNames()
    out = StructType([kinds[c] for c in names])
    arrow = to_arrow_schema(out)
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive", "folder").repartition(n, "archive").mapInArrow(lambda it: _read(it, names, arrow), out)
