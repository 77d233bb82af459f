"""Web archives: one gzip member for each record, written and read as streams.

A payload that came before is not stored again: its record is a revisit that refers to the
first. The reader goes through a file once, decompresses by and by, cuts the
record's block by its content length, and checks block and payload digests on the way.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import scratch
from plumbline.llm.common import picked

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 18
LEVEL = 6
LONGEST_HEAD = 1 << 20


def opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path that all executors reach, and the path in it."""
    return FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def field(value: str) -> str:
    """A header's value must not break its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC record, not compressed yet."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {field(url or urn(page_id)[1:-1])}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages with refers_to: the smallest page_id with the same payload, null where that is the page.

    Only digests with a second page are joined back, and pages without id never stand for others."""
    keyed = pages.withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html")
    keyed = keyed.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = keyed.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    joined = keyed.join(first.drop("n"), ["sha1", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, path: str, id_col="page_id", url_col="url", html_col="html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row, in files of about ``file_bytes`` below ``path``.

    A null html is an empty payload, a null url becomes the record's own name, and repeated rows are
    all written; rows that share the smallest id of a payload are all responses. A task
    names its files by attempt, and only those in the committed manifest count, so lost or
    repeated attempts leave nothing behind that is read. An empty table writes an empty manifest.
    """
    chosen = decided(picked(pages, {"page_id": id_col, "url": url_col, "html": html_col}, {"page_id": "bigint", "url": "string", "html": "string"}), least_bytes)

    def run(batches):
        from pyspark import TaskContext

        system, folder = opened(path)
        system.create_dir(f"{folder}/archives", recursive=True)
        context, written = TaskContext.get(), []
        sink, left = None, 0
        try:
            for batch in batches:
                for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                    if sink is None:
                        written.append(f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(written)}-{uuid.uuid4().hex[:8]}.warc.gz")
                        sink, left = system.open_output_stream(f"{folder}/archives/{written[-1]}", compression=None), file_bytes
                    raw = member(record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py()))
                    sink.write(raw)
                    left -= len(raw)
                    if left <= 0:
                        sink.close()
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], names=["file"])

    chosen.mapInArrow(run, "file string").write.parquet(f"{path}/manifest")


class Damaged(ValueError):
    """An archive that does not hold what it says."""


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a stream of gzip members, checked by length and digest."""
    raw = b""
    while True:
        raw = raw or stream.read(READ_BYTES)
        if not raw:
            return
        unpack, held, fields, block, wanted, sha1 = zlib.decompressobj(31), b"", None, [], 0, hashlib.sha1()
        while not unpack.eof:
            raw = raw or stream.read(READ_BYTES)
            if not raw:
                raise Damaged("the file ends within a record")
            held += unpack.decompress(raw, READ_BYTES)
            raw = unpack.unconsumed_tail or unpack.unused_data
            if fields is None and b"\r\n\r\n" in held:
                head, held = held.split(b"\r\n\r\n", 1)
                version, *lines = head.decode().split("\r\n")
                fields = dict(line.split(": ", 1) for line in lines)
                if not version.startswith("WARC/"):
                    raise Damaged("not a WARC record")
                wanted = int(fields["Content-Length"])
            if fields is None and len(held) > LONGEST_HEAD:
                raise Damaged("a record's head does not end")
            if fields is not None and wanted:
                part, held = held[:wanted], held[wanted:]
                sha1.update(part)
                block.append(part)
                wanted -= len(part)
        if fields is None or wanted or held != b"\r\n\r\n":
            raise Damaged("a record's length differs from its content length")
        if fields.get("WARC-Block-Digest", "") != f"sha1:{base64.b32encode(sha1.digest()).decode()}":
            raise Damaged(f"the block of {fields.get('WARC-Record-ID')} is damaged")
        yield fields, b"".join(block)


def content(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """(size of the full payload, payload or None for a revisit), the payload checked by its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)\r?$", http)[1])
    if fields["WARC-Type"] == "revisit":
        return size, None
    if len(payload) != size or f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
        raise Damaged(f"the payload of {fields.get('WARC-Record-ID')} is damaged")
    return size, payload


def read(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    One task reads a file from begin to end; a damaged record fails the job."""
    files = spark.read.parquet(f"{path}/manifest").select("file")

    def run(batches):
        system, folder = opened(path)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        rows, size = [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with system.open_input_stream(f"{folder}/archives/{file}", compression=None) as stream:
                    for fields, block in records(stream):
                        full, payload = content(fields, block)
                        rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), full, fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload if with_payload else None))
                        size += len(block) if with_payload else 0
                        if len(rows) == 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    count = max(1, files.count())
    return files.repartition(count, "file").mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32 = " || ".join(f"substr('{SIGNS}', CAST((v[{g + 1}] >> {s}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
h AS (SELECT page_id, p.html, first_id, [CAST('0x' || substr(sha1(p.html), CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) for g in generate_series(0, 7)] AS v FROM p JOIN f ON p.html = f.html)
SELECT page_id, strlen(html) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM h
"""


def op8_warc(spark, sf: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf}/pages.parquet"), path)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
