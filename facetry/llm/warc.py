"""WARC archives (operator 1): a writer, and a reader that splits files at any byte.

The writer makes one gzip member per record. A member ends with the high byte of its length, 0 below 16 MiB; that byte
is left to Spark's text writer as its line separator, so Spark commits whole standard .warc.gz files on any file system
and a lost task leaves nothing half written. A longer record is followed by an empty member, which ends in 0 too.

The reader deals byte ranges to tasks. A task scans its range for the gzip magic, accepts a candidate if the member
decodes whole (with its checksum) to a WARC header and a block of the stated length, and owns the records that start in
its range; the last may end beyond it. A payload that holds stored, uncompressed WARC members of its own can be read as
such where a range starts within it.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.shared import partitions, settled, shared_folder, table

MAGIC = b"\x1f\x8b\x08"
RECORD = "file string, record_offset long, record_id string, record_type string, target_uri string, payload_digest string, refers_to_id string, http_length long, payload binary"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member (and an empty one, if need be) without its last byte, which is 0."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += pack.compress(b"") + pack.flush()
    return out[:-1]


def record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_firsts(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(k, u, p, d) -> adds first: the least key of the payloads that are equal by digest, null where there is one only."""
    same = rows.where(F.octet_length("p") >= least_bytes).groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    # Settled, so that the join has an exchange on both sides and a digest of most rows can be split.
    return rows.join(settled(same.where("n > 1").drop("n")), "d", "left").select("k", "u", "p", "d", "first")


def write_warc(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> None:
    """Writes a record per row. Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest
    key is the response and the others revisit it; smaller payloads are all responses. A null payload is empty, a null
    uri becomes empty, line breaks in a uri are dropped; a row with a null key never is the one revisited, unless all are; equal keys
    with equal payloads are all responses. Other columns are ignored; an empty table writes no record."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select(F.col(key).cast("long").alias("k"), F.regexp_replace(F.coalesce(F.col(uri), F.lit("")), "[\\r\\n]", "").alias("u"), body.alias("p"), F.unhex(F.sha1(body)).alias("d"))

    def run(batches):
        for batch in batches:
            out = []
            for k, u, p, d, first in zip(*(batch.column(i) for i in range(5))):
                k, u, p, digest, first = k.as_py(), u.as_py(), p.as_py(), base64.b32encode(d.as_py()).decode(), first.as_py()
                again = first is not None and k != first
                out.append(member(record("revisit" if again else "response", f"urn:page:{k}", u, digest, p, f"urn:page:{first}" if again else None, date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    with_firsts(rows, least_bytes).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path, lineSep="\0")


class _Bytes:
    """A file from some byte on, read as far as it is asked for."""

    STEP = 1 << 20

    def __init__(self, path: str, start: int):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
        self.file = system.open_input_file(name)
        self.size, self.start, self.data = self.file.size(), start, bytearray()

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.data += self.file.read_at(max(end - have, min(self.STEP, self.size - have)), have)

    def drop(self, before: int) -> None:
        if before - self.start > 8 * self.STEP:
            del self.data[: before - self.start]
            self.start = before

    def at(self, offset: int, length: int) -> bytes:
        self.upto(offset + length)
        return bytes(self.data[offset - self.start : offset - self.start + length])

    def find(self, what: bytes, offset: int, end: int) -> int:
        """The first place of ``what`` from ``offset`` that lies before ``end``, or -1."""
        while offset < end:
            self.upto(min(end, offset + self.STEP) + len(what) - 1)
            i = self.data.find(what, offset - self.start, min(end, offset + self.STEP) - self.start + len(what) - 1)
            if i >= 0:
                return self.start + i
            offset += self.STEP
            self.drop(offset)
        return -1


def decode_member(source: _Bytes, offset: int) -> tuple[bytes, int] | None:
    """(record, end of the member), or None if no WARC record starts at ``offset``."""
    unpack, out, at = zlib.decompressobj(31), bytearray(), offset
    try:
        while not unpack.eof:
            piece = source.at(at, 1 << 16)
            if not piece:
                return None
            out += unpack.decompress(piece)
            at += len(piece)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return (bytes(out), at - len(unpack.unused_data)) if out.startswith(b"WARC/") else None


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not gap or not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        return None
    return fields, rest[: int(length)]


def scan(path: str, start: int, end: int):
    """(offset, fields, block) of the records that start in [start, end)."""
    source, at = _Bytes(path, start), start
    while (at := source.find(MAGIC, at, end)) >= 0:
        found = decode_member(source, at)
        parsed = parse_record(found[0]) if found else None
        if parsed:
            yield at, *parsed
            at = found[1]
            source.drop(min(at, source.start + len(source.data)))
        else:
            at += 1


def read_warc(spark: SparkSession, path: str, range_bytes: int = 16 << 20) -> DataFrame:
    """The records of all files below ``path``; see ``RECORD``. A response's payload is what follows its HTTP header."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    step = F.lit(range_bytes).cast("long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))

    def run(batches):
        for batch in batches:
            for file, start in zip(batch["path"], batch["start"]):
                rows, held = [], 0
                for offset, fields, block in scan(file, int(start), int(start) + range_bytes):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    rows.append((file, offset, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), fields.get("warc-refers-to"), int(size[0]) if size else None, body))
                    held += len(block)
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in RECORD.split(", ")]
    return ranges.repartition(partitions(spark), "path", "start").mapInPandas(run, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"), F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", F.when(F.col("refers_to_id").isNotNull(), number("refers_to_id")).alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p),
d AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
