"""WARC archives: one gzip member a record, written by tasks and read back from byte ranges.

The reader's tasks get ranges of a file. A task looks for the gzip magic in its range, takes a place as the start of a
member if the bytes there inflate to the head of a WARC record, and reads every record that starts inside its range, also
beyond the range's end. So any split gives each record once, and a file of any size is read in parallel.

Defined results: a null payload is empty; a null url gives a record without target; null or repeated page ids give records
as any other (of equal payloads the first by page_id, nulls last, is the response; where that id is repeated, so are responses);
an empty table gives no files and no rows; further columns are ignored.
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

from .shared import checkpoint, fresh_dir, n_parts, table

#: Bytes of a range that one task scans.
RANGE = 8 << 20
#: Tasks that read ranges, for each partition of a shuffle.
TASKS = 64
MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member: a response, or a revisit of the record refers_to, which has the digest and length but no payload."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_quote(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}",
    ]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def _quote(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unquote(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _writer(uri: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = fs.FileSystem.from_uri(uri)
        name, out, size, count = uuid.uuid4().hex, None, 0, 0
        for batch in batches:
            payloads = batch.column(2).cast(pa.large_binary()).to_pylist()
            for page_id, url, payload, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(), strict=True):
                out = out or at.open_output_stream(f"{root}/{name}.open")
                member = record(page_id, url, payload or b"", refers, level)
                out.write(member)
                size += len(member)
                count += 1
        if out is not None:
            out.close()
            at.move(f"{root}/{name}.open", f"{root}/{name}.warc.gz")
            yield pa.RecordBatch.from_pylist([{"file": f"{name}.warc.gz", "bytes": size, "records": count}], schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return write


def write_archives(pages: DataFrame, uri: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Writes pages (page_id, url, html) below uri, a file a task. Returns (file, bytes, records) of the files of tasks that succeeded.

    Digests meet without their payloads; who refers to whom then joins the pages by id and digest, so that a payload with a third of all rows is no key.
    """
    at, root = fs.FileSystem.from_uri(uri)
    at.create_dir(root)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = pages.withColumn("_sha", F.sha1(F.encode("html", "utf-8")))
    # only digests that occur twice go on to the join with the pages; hot ones are one row each after partial aggregation
    by = hashed.where(F.octet_length("html") >= min_bytes).groupBy("_sha").agg(F.min("page_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    again = hashed.select("page_id", "_sha").join(by.where("_n > 1 and _least is not null").drop("_n"), "_sha").where(~F.col("page_id").eqNullSafe(F.col("_least")))
    again = again.select(F.col("page_id").alias("_id"), F.col("_sha").alias("_of"), "_least").distinct()
    marked = hashed.join(again, hashed["page_id"].eqNullSafe(F.col("_id")) & (hashed["_sha"] == F.col("_of")), "left")
    made = marked.select("page_id", "url", "html", F.col("_least").alias("refers")).mapInArrow(_writer(uri, level), "file string, bytes long, records long")
    return checkpoint(made)  # written once


_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def parse(raw: bytes) -> dict:
    """One inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    full = fields["WARC-Type"] == "response"
    return {
        "page_id": number("WARC-Record-ID"), "url": _unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, "payload": payload if full else None,
        "payload_bytes": len(payload) if full else int(fields["WARC-Payload-Length"]), "payload_digest": digest(payload) if full else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
    }


def _starts_record(head: bytes) -> bool:
    """Whether the bytes inflate to the head of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(head, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(source, start: int, end: int, size: int, step: int = 1 << 20) -> Iterator[dict]:
    """The records of the gzip members that start in [start, end) of an open file."""
    at, buffer, base = start, b"", start  # buffer holds the bytes from base on

    def fill(to: int) -> None:
        nonlocal buffer
        if to > base + len(buffer) and base + len(buffer) < size:
            source.seek(base + len(buffer))
            buffer += source.read(max(step, to - base - len(buffer)))

    while at < end:
        fill(at + 4096)
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(buffer) - 2)  # the magic may lie across two reads
            if base + len(buffer) >= size:
                return
            buffer, base = buffer[at - base :], at
            fill(base + len(buffer) + step)
            continue
        at = base + found
        if at >= end:
            return
        fill(at + 4096)
        if not _starts_record(buffer[at - base : at - base + 4096]):
            at += 1
            continue
        inflate, parts, pos = zlib.decompressobj(31), [], at
        while not inflate.eof:
            fill(pos + step)
            piece = buffer[pos - base : pos - base + step]
            if not piece:
                raise ValueError(f"a member that starts at {at} isn't complete")
            parts.append(inflate.decompress(piece))
            pos += len(piece)
        at = pos - len(inflate.unused_data)
        yield parse(b"".join(parts))
        if at - base > 4 * step:
            buffer, base = buffer[at - base :], at


def _reader(uri: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = fs.FileSystem.from_uri(uri)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                with at.open_input_file(f"{root}/{r['file']}") as source:
                    held, n = [], 0
                    for x in records_in(source, r["start"], r["end"], r["bytes"]):
                        n += len(x["payload"] or b"") if payloads else 0
                        held.append(x if payloads else x | {"payload": None})
                        if len(held) >= 2000 or n > 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, n = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return read


def read_archives(files: DataFrame, uri: str, size: int = RANGE, payloads: bool = True) -> DataFrame:
    """All records of the files (file, bytes) below uri: each is cut into ranges of bytes, which are dealt to as many tasks as there are, up to TASKS for each
    partition of a shuffle."""
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + size, "bytes").alias("end"), "bytes")
    total = files.agg(F.sum(F.ceil(F.col("bytes") / size))).first()[0] or 1
    return ranges.repartition(int(min(total, TASKS * n_parts(files.sparkSession)))).mapInArrow(_reader(uri, payloads), _SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_dir(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), uri)
    return read_archives(files, uri, payloads=False).drop("payload")
