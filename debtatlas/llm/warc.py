"""WARC archives: written by tasks, read back by byte range.

Writer: each task appends gzip members, one per record, to archives of its own in the given
folder and reports them in a manifest that Spark commits, so what a lost or repeated task
leaves behind is never read. Records whose payload equals that of a response are revisits
and carry no payload.

Reader: archives are cut into byte ranges. A task scans its range for the gzip magic, takes
a candidate as a member if it decodes to a WARC header, and owns every record that starts
inside its range, to its end. Files are opened with ``pyarrow.fs``, so a folder may be on a
shared disk, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_folder, settle, steps, table

FILE_BYTES = 256 << 20
#: Least size of a byte range, and the most ranges that a set of archives is cut into.
RANGE_BYTES, MAX_RANGES = 16 << 20, 200_000
_READ_BYTES = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value) -> str:
    flat = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {flat}\r\n"


def record_bytes(record_id: str, url: str | None, payload: bytes, date: str,
                 refers_to: str | None) -> bytes:
    """One record: a response, or without payload a revisit of ``refers_to``."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = "WARC/1.1\r\n" + _line("WARC-Type", "revisit" if refers_to else "response")
    head += _line("WARC-Record-ID", record_id) + _line("WARC-Date", date)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    head += _line("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")
    head += _line("X-Payload-Length", len(payload))
    if refers_to:
        head += _line("WARC-Profile", _PROFILE) + _line("WARC-Refers-To", refers_to)
    else:
        block += payload
    head += _line("Content-Type", "application/http; msgtype=response")
    head += _line("Content-Length", len(block))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _write(folder: str, date: str):
    def run(batches):
        out, path, size, count = None, None, 0, 0
        system, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"part-{uuid.uuid4()}.warc.gz", 0, 0
                    path, out = f"{folder}/{name}", system.open_output_stream(
                        f"{root}/{name}", compression=None)
                size += out.write(member(record_bytes(
                    row["record_id"], row["url"], (row["html"] or "").encode(), date,
                    row["refers_to"])))
                count += 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict(
                        {"path": [path], "bytes": [size], "records": [count]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})
    return run


def write_pages(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url",
                html_column: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row into ``folder``; returns the manifest: path, bytes, records.

    Of rows with equal payloads (NULL is empty) the one with the largest id is the response,
    the others revisit it. Rows that share that id are all responses, and so are rows without
    an id when no equal row has one. Record ids hold the page id. Other columns are ignored;
    an empty table writes nothing.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    digested = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    copies = settle(digested.groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n"))
                    .where("n > 1 and last is not null").drop("n"))

    def name(column: str):
        return F.concat(F.lit("<urn:x-page:"), F.col(column).cast("string"), F.lit(">"))

    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    return settle(digested.join(copies.hint("merge"), "digest", "left").select(
        F.coalesce(name("id"), F.concat(F.lit("<urn:x-digest:"), "digest", F.lit(">"))).alias("record_id"),
        "url", "html",
        F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")),
               name("last")).alias("refers_to"))
        .mapInArrow(_write(folder, date), "path string, bytes long, records long"))


def _scan(handle, start: int, stop: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, record) of each member that starts in [start, stop)."""
    at, base, held = start, start, b""
    while at < stop:
        found = held.find(_MAGIC, at - base) if base <= at else -1
        if found < 0:
            # keep two bytes: the magic may lie across two reads
            tail = max(at, base + len(held) - 2) if held else at
            handle.seek(tail)
            held, base, at = handle.read(_READ_BYTES), tail, tail
            if len(held) < len(_MAGIC):
                return
            if held.find(_MAGIC) < 0:
                at = base + len(held) - 2
                if base + len(held) >= size:
                    return
                held = b""
            continue
        at = base + found
        if at >= stop:
            return
        end, record = _member_at(handle, at, held[found:], size)
        if record is None:
            at += 1
            continue
        yield at, end, record
        at = end
        if not base <= at < base + len(held):
            held, base = b"", at


def _member_at(handle, at: int, first: bytes, size: int) -> tuple[int, bytes | None]:
    """End and content of the member at ``at``, or None if there is none with a WARC header."""
    unpack, out, fed, data = zlib.decompressobj(31), [], at, first
    length, checked = 0, False
    try:
        while True:
            out.append(unpack.decompress(data))
            length += len(out[-1])
            fed += len(data)
            if not checked and length >= 5:
                if not b"".join(out).startswith(b"WARC/"):
                    return at, None
                checked = True
            if unpack.eof:
                break
            handle.seek(fed)
            data = handle.read(_READ_BYTES)
            if not data:
                return at, None
    except zlib.error:
        return at, None
    record = b"".join(out)
    if not checked or b"\r\n\r\n" not in record:
        return at, None
    return fed - len(unpack.unused_data), record


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers.get("content-length", len(rest)))
    if len(rest) < size:
        raise ValueError("a WARC record is shorter than its Content-Length")
    return headers, rest[:size]


_RECORD = ("path string, offset long, type string, record_id string, url string, "
           "refers_to string, payload_digest string, payload_bytes long, payload binary")


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            system, place = _filesystem(row["path"])
            with system.open_input_file(place) as handle:
                rows, held = [], 0
                for offset, _, record in _scan(handle, row["start"], row["stop"], handle.size()):
                    rows.append(_record_row(row["path"], offset, record))
                    held += len(record)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)


_RECORD_ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()),
    ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _record_row(path: str, offset: int, record: bytes) -> dict:
    headers, block = parse(record)
    kind = headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    length = headers.get("x-payload-length")
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest not in (None, base32_sha1(payload)):
            raise ValueError(f"{path} at {offset}: the payload does not have its digest")
        digest, length = base32_sha1(payload), len(payload)
    return {"path": path, "offset": offset, "type": kind, "record_id": headers.get("warc-record-id"),
            "url": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": None if length is None else int(length),
            "payload": payload}


def read_records(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per record of the archives in ``manifest`` (path, bytes).

    Gives path, offset, type, record_id, url, refers_to, payload_digest, payload_bytes and, for
    responses, payload, whose digest is checked. A record is read once, by the range it starts
    in. Headers may have any length. Bytes that belong to no WARC member are passed over. No
    archives: no rows.
    """
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    size = max(range_bytes, -(-total // MAX_RANGES))
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = settle(ranges.select("path", "start", F.least("bytes", F.col("start") + size).alias("stop")))
    # a range a task: by hash some would get several and others none
    return ranges.repartitionByRange(max(1, ranges.count()), "path", "start").mapInArrow(_read, _RECORD)


def all_read(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records`` (written, with their path); an error if an archive gave another number of them
    than its writer reported in the manifest."""
    found = records.groupBy("path").agg(F.count("*").alias("found"))
    wrong = (manifest.groupBy("path").agg(F.sum("records").alias("written")).join(found, "path", "full")
             .where("not (found <=> written)").first())
    if wrong is not None:
        raise RuntimeError(f"{wrong.path}: {wrong.written} records written, {wrong.found} read")
    return records


def write_and_read(pages: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    def page(column: str):
        return F.expr(f"cast(nullif(regexp_extract({column}, '^<urn:x-page:(-?[0-9]+)>$', 1), '')"
                      " as bigint)")

    with steps(pages.sparkSession) as keep:
        manifest = write_pages(pages, folder)
        records = keep(read_records(manifest, range_bytes).select(
            "path", page("record_id").alias("page_id"), "payload_bytes", "payload_digest",
            F.col("type").alias("record_type"), page("refers_to").alias("refers_to")))
        return all_read(records, manifest).drop("path")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return write_and_read(table(spark, folder, "pages"), scratch_folder(spark, "warc"))
