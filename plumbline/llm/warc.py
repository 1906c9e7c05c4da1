"""WARC archives compressed with zstandard: one frame for each record, a dictionary in the leading skippable frame.

Writing: each task trains a dictionary on its first records and writes archives of bounded size into the shared folder,
under names that no other attempt uses; the manifest lists those of the attempts that count. Reading: each archive is
streamed, its dictionary loaded, every frame decoded to one record, and headers, lengths and digests are validated.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, shared_dir, written

SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES, DICTIONARY, SAMPLES, SAMPLE_BYTES, LEVEL = 32 << 20, 16 << 10, 128, 1 << 20, 3
READ = 32 << 10
DATE = "2000-01-01T00:00:00Z"  # capture times are not in the table
PAGE, REFERS = "WARC-X-Page-ID", "WARC-X-Refers-To-Page-ID"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record of an id of its own; payload is None for a revisit.

    The page's number, and that of the page a revisit refers to, stand in fields of their own, since pages may repeat.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"{PAGE}: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if payload is None:
        lines += [f"WARC-Profile: {REVISIT}", f"{REFERS}: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


class Writer:
    """Writes records to archives below a folder that pyarrow's file systems reach."""

    def __init__(self, folder: str):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.uri, self.file, self.waiting = folder, None, []

    def open(self) -> None:
        content = dictionary(self.waiting[:SAMPLES])
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(content)
        self.size = self.file.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed) or 8 + len(packed)
        self.records, self.frames = 0, zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content))

    def flush(self) -> None:
        if self.waiting and not self.file:
            self.open()
        for r in self.waiting:
            frame = self.frames.compress(r)
            self.file.write(frame)
            self.size += len(frame)
            self.records += 1
        self.waiting, self.held = [], 0

    def add(self, data: bytes) -> None:
        self.waiting.append(data)
        self.held = getattr(self, "held", 0) + len(data)
        if self.file or len(self.waiting) >= SAMPLES or self.held >= SAMPLE_BYTES:
            self.flush()

    def close(self) -> list[tuple[str, int, int]]:
        """Finish the current archive; its path, records and bytes."""
        self.flush()
        if not self.file:
            return []
        self.file.close()
        self.file = None
        return [(f"{self.uri}/{self.name}", self.records, self.size)]


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, after loading its dictionary."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    content = stream.read(size)
    if len(content) != size:
        raise ValueError("the dictionary frame is cut short")
    content = zstandard.ZstdDecompressor().decompress(content) if content[:4] == FRAME else content
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    rest = b""
    while True:
        rest = rest or stream.read(READ)
        if not rest:
            return
        one, parts = decoder.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(READ)
            if not rest:
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Fields of one record; a ValueError names what is wrong with it."""
    head, sep, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC/1.1 record: {lines[0][:40]}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if len(body) != int(fields["Content-Length"]) + 4 or body[-4:] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: its length is not {fields['Content-Length']}")
    kind = fields["WARC-Type"]
    http, sep, payload = body[:-4].partition(b"\r\n\r\n")
    sizes = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not sep or len(sizes) != 1 or kind not in ("response", "revisit"):
        raise ValueError(f"{fields['WARC-Record-ID']}: not a response or revisit of HTTP")
    if kind == "response" and (len(payload) != sizes[0] or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: its payload does not match its length or digest")
    if kind == "revisit" and payload:
        raise ValueError(f"{fields['WARC-Record-ID']}: a revisit with a payload")
    if kind == "revisit" and (REFERS not in fields or fields.get("WARC-Profile") != REVISIT):
        raise ValueError(f"{fields['WARC-Record-ID']}: a revisit of nothing")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number(PAGE), "payload_bytes": sizes[0], "payload_digest": digest,
        "record_type": kind, "refers_to": number(REFERS), "payload": payload if kind == "response" else None,
    }


def classify(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), n, sha1 (hex) and refers_to of every page.

    Of the rows with an equal payload of at least `least` bytes, those with the smallest page_id are responses and the
    others revisit it; rows without a page_id are responses.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.octet_length(body).cast("long").alias("n"), F.sha1(body.cast("binary")).alias("sha1"))
    groups = rows.filter(F.col("n") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = written(groups.filter("copies > 1 AND first IS NOT NULL").select("sha1", "first"), "payloads")
    out = join_small(rows, repeated, "sha1", "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return out.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "n", "sha1", F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives of classified pages below folder; returns the manifest (path, records, bytes), itself stored."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        w, done = Writer(folder), []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page_id, url, html, n, sha1, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    w.add(record(page_id, url, None if html is None else html.encode(), n, digest, refers_to))
                    if w.file and w.size >= ARCHIVE_BYTES:
                        done += w.close()
        done += w.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return written(pages.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives that manifest lists: page_id, payload_bytes, payload_digest (bare base32
    SHA-1), record_type, refers_to and payload (null for revisits). A malformed record fails the query."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    types = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def run(batches):
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pa.fs.FileSystem.from_uri(path)
                seen, rows, held = 0, [], 0
                with fs.open_input_stream(name) as stream:
                    for data in frames(stream):
                        rows.append(parse(data))
                        seen, held = seen + 1, held + len(data)
                        if len(rows) == 512 or held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))
                if seen != count:
                    raise ValueError(f"{path} holds {seen} records; the manifest says {count}")

    paths = manifest.select("path", "records")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read them back: what the archives say of each page.

    A null html is an empty payload; a null url has no target; a null page_id is a response of its own; repeated rows
    are records of their own; other columns are ignored; an empty table writes no archive and gives no rows. Very long
    pages are one record and one frame each, held whole by a task, one at a time.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    return read(write(classify(pages), folder)).drop("payload")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
d AS (SELECT page_id, strlen(h) payload_bytes, sha1(h) s, min(page_id) OVER (PARTITION BY h) first FROM p),
b AS (SELECT *, CAST(unhex(s) AS BIT)::VARCHAR bits FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN page_id > first THEN first END refers_to FROM b
"""
