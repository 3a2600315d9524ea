"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write_archives`` writes one WARC record for each row into monolithic files, a single gzip stream each.
``normalise`` inflates such a file once, as a stream, and writes every record as a gzip member of its own,
with a sidecar index of offsets beside it.  ``read_records`` then reads any record by its offset alone.

Records with equal payloads of at least ``least`` bytes are written once: the row with the smallest id is a
response, the others revisit it and carry its id, digest and length.

Files are named by partition, written under a temporary name and then moved, so a repeated task writes
the same file again.  They lie in a folder that all executors share; any file system that pyarrow
knows will do.  A task holds one record at a time.

Edge cases: null payload is empty; null url is an empty header.  A row without an id can revisit but is
never revisited; if no row of equal payloads has an id, all are responses.  Repeated rows of the smallest id are all responses.
Extra columns are ignored.  An empty table writes no records and gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dim_join

PIECE = 1 << 20
INDEX = "path string, offset long, length long, record_id string"
RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def store(base: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder; Hadoop writes local ones as file:/x."""
    if base.startswith("/") or base.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^(file:)?/+", "", base)
    return pafs.FileSystem.from_uri(base)


def temporary(path: str) -> str:
    return f"{path}.{TaskContext.get().taskAttemptId()}.tmp"


def publish(fs: pafs.FileSystem, temp: str, path: str) -> None:
    """Move a finished file to its name; what an earlier attempt left there goes."""
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(temp, path)


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    name = lambda n: f"<urn:page:{'' if n is None else quote(n, safe='') or '%'}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflated(stream) -> Iterator[bytes]:
    """The contents of a gzip file in pieces; several members are read one after the other."""
    engine = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            yield engine.decompress(data, PIECE)
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine = zlib.decompressobj(31)
    yield engine.flush()


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream."""
    buffer, need, body = bytearray(), 0, -1
    for piece in pieces:
        buffer += piece
        while True:
            if body < 0:
                body = buffer.find(b"\r\n\r\n")
                if body < 0:
                    break
                need = body + 4 + int(headers(bytes(buffer[:body]))["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            body = -1
    if buffer:
        raise ValueError("the archive ends within a record")


def write_archives(rows: DataFrame, base: str) -> DataFrame:
    """Write rows (page_id, url, payload string, digest, refers_to) and return (path), one monolithic file for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(base)
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        engine, n = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        with fs.open_output_stream(temporary(path), compression=None) as out:
            for batch in batches:
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(engine.compress(record(page_id, url, payload.encode("utf-8"), digest, refers_to)))
                    n += 1
            out.write(engine.flush())
        if n:
            publish(fs, temporary(path), path)
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])
        else:
            fs.delete_file(temporary(path))

    as_text = [F.col(c).cast("string").alias(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
    return rows.select(*as_text).mapInArrow(run, "path string")


def normalise(files: DataFrame, base: str) -> DataFrame:
    """Rewrite monolithic files (path) with a member for each record; return the index (path, offset, length, record_id).

    The same index is written beside each file, as JSON lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(base)
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path = f"{folder}/{source.rpartition('/')[2]}"
                index, offset = [], 0
                with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(temporary(path), compression=None) as out, fs.open_output_stream(temporary(path + ".idx")) as side:
                    for one in records(inflated(stream)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(one) + engine.flush()
                        out.write(member)
                        index.append((path, offset, len(member), headers(one[: one.index(b"\r\n\r\n")])["warc-record-id"]))
                        side.write(json.dumps({"offset": offset, "length": len(member), "record_id": index[-1][3]}).encode() + b"\n")
                        offset += len(member)
                        if len(index) >= 4096:
                            yield as_batch(index, INDEX)
                            index = []
                publish(fs, temporary(path), path)
                publish(fs, temporary(path + ".idx"), path + ".idx")
                if index:
                    yield as_batch(index, INDEX)

    return files.select("path").mapInArrow(run, INDEX)


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def read_records(index: DataFrame, base: str) -> DataFrame:
    """Read each record of an index by its offset; payload digests are computed anew and held against the header."""

    def told(name: str | None) -> str | None:
        """An id as it was written: nothing for null, a bare % for an empty one."""
        quoted = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return "" if quoted == "%" else unquote(quoted) if quoted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(base)
        opened, stream = None, None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != opened:
                    if stream:
                        stream.close()
                    opened, stream = path, fs.open_input_file(path)
                one = zlib.decompress(stream.read_at(length, offset), 31)
                head, _, block = one.partition(b"\r\n\r\n")
                head = headers(head)
                http, _, payload = block[: int(head["content-length"])].partition(b"\r\n\r\n")
                size, digest = int(headers(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path} at {offset}: the payload doesn't have its digest")
                out.append((told(head["warc-record-id"]), size, digest, head["warc-type"], told(head.get("warc-refers-to"))))
            if out:
                yield as_batch(out, RECORD)
        if stream:
            stream.close()

    return index.select("path", "offset", "length").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Write, normalise and read back all rows: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = dim_join(rows, firsts, ["digest"], "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    files = cut(write_archives(rows, f"{base}/monolithic"))
    index = cut(normalise(files, f"{base}/records"))
    kind = rows.schema["page_id"].dataType
    return read_records(index, f"{base}/records").withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
