"""Operator 10: WARC archives, written and read in parallel.

Every record is a gzip member of its own. The reader is splittable: a task gets a byte range, looks for gzip's magic
bytes, takes a place for a member only if decoding it yields a WARC header, and owns the records that start inside its
range; the last one may end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, materialize, new_path, table
from .files import attempt_name, filesystem

MAGIC, DATE, LEAST = b"\x1f\x8b\x08", "2024-01-01T00:00:00Z", 0
SPLIT, READ, LONGEST_HEADER = 4 << 20, 1 << 20, 1 << 16
COLUMNS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit without payload where refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:x-page:{page_id}>")
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if refers_to is not None else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least so many bytes the row of largest page_id is kept.

    Equal means the same SHA-1 and length. Rows that share the largest page_id are all responses, and so are all rows
    of a payload whose page_ids are all null; other null page_ids are revisits.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    kept = rows.filter(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("original"))
    joined = rows.join(kept, ["sha", "n"], "left")
    same = F.col("original").isNull() | F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "payload", F.when(~same, F.col("original")).alias("refers_to"))


def write_warc(pages: DataFrame, out: str, least: int = LEAST) -> DataFrame:
    """Write one archive a task under the folder out; returns (path, n_bytes, n_records) of each, as a table.

    A retried task writes under another name; the table names the files that count.
    """

    def write(batches):
        _, name = attempt_name(".warc.gz")
        system, folder = filesystem(out)
        system.create_dir(folder, recursive=True)
        size = n = 0
        with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, payload, refers_to)) + packer.flush()
                    f.write(data)
                    size, n = size + len(data), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{out}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "n_bytes", "n_records"])

    return materialize(with_originals(pages, least).mapInArrow(write, "path string, n_bytes long, n_records long"), "warc-manifest")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_bytes) of the archives in a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("n_bytes"))


class Window:
    """A file read forward from some place."""

    def __init__(self, file, size: int, at: int, step: int):
        self.file, self.size, self.start, self.data, self.step = file, size, at, b"", step

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        got = self.file.read(min(self.step, self.size - at))
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        self.data, self.start = self.data[upto - self.start :], upto


def member_at(window: Window, place: int, header_only: bool) -> tuple[bytes, int] | None:
    """(content, place after it) of the gzip member at a place, or None if there is none that begins like a record."""
    unpack, out, at, seen = zlib.decompressobj(31), [], place - window.start, 0
    while True:
        if at >= len(window.data) and not window.more():
            return None
        part = window.data[at : at + (1 << 12 if header_only else 1 << 16)]
        try:
            got = unpack.decompress(part)
        except zlib.error:
            return None
        out.append(got)
        seen += len(got)
        at += len(part)
        if seen >= 5 or unpack.eof:
            head = b"".join(out[:2])[:5] if header_only else b"".join(out[:1])[:5]
            if header_only or (len(out) == 1 and len(head) == 5):
                if not head.startswith(b"WARC/"):
                    return None
            if header_only:
                whole = b"".join(out)
                if b"\r\n\r\n" in whole or unpack.eof:
                    return whole, window.start + at
                if len(whole) > LONGEST_HEADER:
                    return None
        if unpack.eof:
            return b"".join(out), window.start + at - len(unpack.unused_data)


def records_in(file, size: int, begin: int, stop: int, step: int = READ):
    """Contents of the records that start in [begin, stop)."""
    window, place = Window(file, size, begin, step), begin
    while place < stop:  # find the first member
        hit = window.data.find(MAGIC, place - window.start)
        if hit < 0:
            place = max(place, window.start + len(window.data) - 2)
            window.drop(place)
            if not window.more():
                return
            continue
        place = window.start + hit
        if place >= stop:
            return
        if member_at(window, place, True):
            break
        place += 1
    else:
        return
    while place < stop:  # then members follow each other
        got = member_at(window, place, False)
        if got is None:
            if place >= size:
                return
            place += 1  # damaged: look for the next one
            yield from records_in(file, size, place, stop, step)
            return
        yield got[0]
        place = got[1]
        window.drop(place)


def parse(content: bytes) -> dict:
    """The columns of one record. The payload is null for a revisit."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    body = rest[: int(fields.get("Content-Length", 0))]
    number = lambda name: int(m[1]) if (m := re.search(r"urn:x-page:(-?\d+)", fields.get(name, ""))) else None
    kind = fields.get("WARC-Type")
    url = fields.get("WARC-Target-URI")
    response = kind != "revisit"
    return {
        "page_id": number("WARC-Record-ID"), "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), "payload": body if response else None,
        "payload_bytes": len(body) if response else int(fields.get("X-Payload-Length", 0)),
        "payload_digest": sha1_base32(body) if response else fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
        "record_type": kind, "refers_to": number("WARC-Refers-To"),
    }


def read_warc(archives: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """Records of archives (path, n_bytes): page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Digests and lengths of responses are computed from what is read, those of revisits come from their headers. Without
    payload that column is null. Bytes that are no record are skipped; an empty list gives an empty table.
    """
    ranges = archives.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("begin"))

    def read(batches):
        for batch in batches:
            for path, size, begin in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, place = filesystem(path)
                rows, held = [], 0
                with system.open_input_file(place) as f:
                    for content in records_in(f, size, begin, begin + split):
                        row = parse(content)
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(content) if payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)

    return dealt(ranges).mapInArrow(read, COLUMNS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS original FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) % 32 + 1 AS INT), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN original IS NULL OR page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM m
"""
}
