"""WARC archives: a writer with revisit records, and a salvage reader.

The reader takes plain archives and archives of gzip members, record by record, and checks of each:
the member's own checksum, version line, header lines, content length, the end of the block, and the block
and payload digests. After a failed check it searches for the next place where a valid member or a version
line begins, goes on from there, and reports the bytes in between as a quarantined gap. The content of a member
is searched for version lines in the same way, as far as it unpacks, so a damaged record or a missing tail costs
no other record of the member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import files
from hirelake.llm.batches import Batches, as_array, slices
from hirelake.operators.keys import lookup
from hirelake.session import staged, staging_path

# Compressed bytes after which the writer begins another file.
FILE_BYTES = 64 << 20
# A payload of fewer bytes is never stored as a revisit.
REVISIT_BYTES = 100
CHUNK = 1 << 20
FEED = 1 << 14
RECORD_URN = "urn:page:"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP_MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEADER_BYTES = 1 << 20  # a longer header is a failed check


# Writing

def roles(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``payload``, ``digest``, ``refers_to`` (null: a response).

    Of equal payloads of at least ``REVISIT_BYTES`` bytes, the page with the smallest id is the
    response. Rows with that same id are responses too; a null id is never the smallest.
    """
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    rows = pages.select(pages[id_column].cast("bigint").alias("page_id"), pages[url_column].cast("string").alias("url"),
                        pages[payload_column].alias("payload")) \
        .withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= REVISIT_BYTES
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")) \
        .where("n > 1").drop("n")
    joined = lookup(rows, first, ["digest"], ["digest"])
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return joined.select("page_id", "url", "payload", "digest",
                         F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP header of the response it stands for, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"<{RECORD_URN}{'none' if page_id is None else page_id}>"


def one_line(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
          compressed: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row to archives in the shared folder; returns their ``path``, ``size``, ``n_records``.

    A null payload is empty, a null url an empty target; a null id is written as such. An empty table
    gives no archive. Other columns are not read.
    """
    folder = staging_path(pages.sparkSession, "warc")

    def work(batches: Batches) -> Batches:
        made: list[tuple[str, int, int]] = []
        stream = path = None
        size = n = 0
        for part in slices(batches, "payload"):
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if stream is None:
                    path = files.new_file(folder, ".warc.gz" if compressed else ".warc")
                    stream, size, n = files.output(path), 0, 0
                page_id, url, payload, digest, refers_to = row
                data = record(page_id, url, payload.encode(), digest, refers_to)
                if compressed:
                    data = gzip.compress(data, 4, mtime=0)
                stream.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    stream.close()
                    made.append((path, size, n))
                    stream = None
        if stream is not None:
            stream.close()
            made.append((path, size, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), as_array([m[1] for m in made], pa.int64()),
             as_array([m[2] for m in made], pa.int64())], names=["path", "size", "n_records"])

    rows = roles(pages, id_column, url_column, payload_column)
    return staged(rows.mapInArrow(work, "path string, size bigint, n_records bigint"), "archives")


# Reading

@dataclass
class Found:
    """A record, or a gap if ``problem`` is set; inside a member, with its place in the member's content."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    problem: str = ""
    inner_start: int | None = None
    inner_end: int | None = None


class Failed(Exception):
    pass


class Window:
    """Bytes of a file from a place on, read as needed; what lies before is let go."""

    def __init__(self, stream, size: int | None = None):
        self.stream, self.base, self.held, self.ended = stream, 0, bytearray(), False
        self.size = size  # of the file, if known
        self.blank = (0, 0, False)  # from, to: no empty line begins between; whether one begins at the end of that

    def more(self) -> bool:
        data = b"" if self.ended else self.stream.read(CHUNK)
        self.held += data
        self.ended = not data
        return bool(data)

    def reach(self, at: int) -> bool:
        """Whether the file has ``at`` bytes or more; reads that far."""
        while self.base + len(self.held) < at and self.more():
            pass
        return self.base + len(self.held) >= at

    def forget(self, at: int) -> None:
        del self.held[:at - self.base]
        self.base = at

    def bytes(self, start: int, end: int) -> bytes:
        self.reach(end)
        return bytes(self.held[start - self.base:end - self.base])

    def header_end(self, start: int, longest: int) -> int:
        """Where the next empty line behind ``start`` begins; -1 if it is further off than ``longest``, or nowhere.

        What was learnt is kept, so false beginnings one after the other do not read the same bytes again.
        """
        since, upto, found = self.blank
        if not since <= start <= upto:
            since, upto, found = start, start, False
        while not found:
            at = self.held.find(b"\r\n\r\n", max(start, upto) - self.base)
            upto, found = (self.base + at, True) if at >= 0 else (max(upto, self.base + len(self.held) - 3), False)
            if not found and (upto - start > longest or not self.more()):
                break
        self.blank = since, upto, found
        return upto if found and upto - start <= longest else -1

    def find(self, pattern: re.Pattern, at: int, longest: int) -> int:
        """Where the pattern, of at most ``longest`` bytes, is next found; -1 if nowhere. What was searched is let go."""
        while True:
            self.forget(min(at, self.base + len(self.held)))
            match = pattern.search(self.held, at - self.base)
            if match and (match.end() < len(self.held) or self.ended):
                return self.base + match.start()
            at = max(at, self.base + len(self.held) - longest + 1)
            if match:
                at = self.base + match.start()
            if not self.more():
                match = pattern.search(self.held, max(0, at - self.base))
                return self.base + match.start() if match else -1


def parsed(window: Window, start: int) -> Found:
    """The plain record that begins at ``start``."""
    if not window.reach(start + 10) or not VERSION.match(window.held, start - window.base):
        raise Failed("no version line")
    stop = window.header_end(start, HEADER_BYTES)
    if stop < 0:
        raise Failed("header without end")
    headers = {}
    at = window.held.find(b"\r\n", start - window.base) + window.base
    while at < stop:  # line by line, so that a false beginning fails at its first line
        end = window.held.find(b"\r\n", at + 2 - window.base) + window.base
        name, colon, value = window.bytes(at + 2, end).decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise Failed("header line without a name")
        headers[name.strip().lower()] = value.strip()
        at = end
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 15:
        raise Failed("no content length")
    body = stop + 4
    end = body + int(length)
    # A length that the file cannot hold is wrong; nothing has to be read to see that.
    if window.size is not None and end + 4 > window.size or not window.reach(end + 4):
        raise Failed("record is cut off")
    if window.bytes(end, end + 4) != b"\r\n\r\n":
        raise Failed("record does not end where it should")
    made = Found(start, end + 4, headers, window.bytes(body, end))
    checked(made)
    return made


def checked(found: Found) -> None:
    """Fails where a mandatory field is missing or a digest of a known kind differs."""
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not found.headers.get(name):
            raise Failed(f"no {name}")
    block = found.headers.get("warc-block-digest", "")
    if not agrees(block, found.block):
        raise Failed("block digest differs")
    if found.headers["warc-type"] == "response" and not agrees(found.headers.get("warc-payload-digest", ""),
                                                               payload_of(found)):
        raise Failed("payload digest differs")


def agrees(given: str, data: bytes) -> bool:
    kind, _, value = given.partition(":")
    if kind == "sha1":
        return value.upper() in (sha1(data), hashlib.sha1(data).hexdigest().upper())
    if kind == "sha256":
        return value.lower() == hashlib.sha256(data).hexdigest()
    return True


def payload_of(found: Found) -> bytes:
    """What follows the HTTP header in the block of a response."""
    if not found.headers.get("content-type", "").startswith("application/http"):
        return found.block
    _, _, payload = found.block.partition(b"\r\n\r\n")
    return payload


def fed(window: Window, at: int) -> bytes:
    return bytes(window.held[at - window.base:at - window.base + FEED]) if window.reach(at + 1) else b""


def member(window: Window, start: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at ``start``, or what unpacks of it and the check that failed."""
    unpack = zlib.decompressobj(16 + zlib.MAX_WBITS)
    parts, at = [], start
    try:
        while not unpack.eof:
            data = fed(window, at)
            if not data:
                return b"".join(parts), at, "member is cut off"
            parts.append(unpack.decompress(data))
            at += len(data)
    except zlib.error:
        # What the failed call had unpacked is lost with it: again from the start, the last bytes one by one.
        unpack = zlib.decompressobj(16 + zlib.MAX_WBITS)
        unpack.decompress(window.bytes(start, at))
        try:
            for i in range(len(data)):
                parts.append(unpack.decompress(data[i:i + 1]))
        except zlib.error:
            pass
        return b"".join(parts), at, "member does not unpack"
    return b"".join(parts), at - len(unpack.unused_data), ""


def packed_end(window: Window, start: int, size: int) -> int:
    """Where the first ``size`` bytes of content of the member at ``start`` are unpacked; it has so many."""
    unpack, at, length = zlib.decompressobj(16 + zlib.MAX_WBITS), start, 0
    while True:
        before, data = unpack.copy(), fed(window, at)
        try:
            grown = length + len(unpack.decompress(data))
        except zlib.error:
            break
        if grown >= size or not data:
            break
        at, length = at + len(data), grown
    for i in range(len(data)):
        length += len(before.decompress(data[i:i + 1]))
        if length >= size:
            return at + i + 1
    return at + len(data)


class Memory:
    """A stream over bytes already there."""

    def __init__(self, data: bytes):
        self.data = data

    def read(self, _: int) -> bytes:
        data, self.data = self.data, b""
        return data


def members_records(window: Window, start: int) -> tuple[list[Found], int, str]:
    """Records and inner gaps of the member at ``start``, where they end, and the member's own failed check.

    If the member is damaged, they end with its last sound record. Where its checksum or its packing fails, a record
    is sound only by a block digest, and not if it is all of the member: then the failed check is its own. A digest
    does not cover the record's header.
    """
    content, end, problem = member(window, start)
    inner = list(salvaged(Memory(content), members=False, size=len(content)))
    if problem == "member does not unpack":
        inner = [f if f.problem or has_digest(f) else Found(f.start, f.end, problem=problem) for f in inner] \
            if len(inner) > 1 else []
    while problem and inner and inner[-1].problem:
        inner.pop()
    if not inner:
        return [], start, problem or "member is empty"
    if problem:
        end = packed_end(window, start, inner[-1].end)
    return [Found(start, end, f.headers, f.block, f.problem, f.start, f.end) for f in inner], end, problem


def has_digest(found: Found) -> bool:
    return found.headers.get("warc-block-digest", "").partition(":")[0] in ("sha1", "sha256")


STARTS = re.compile(re.escape(GZIP_MAGIC) + rb"|" + VERSION.pattern)


def salvaged(stream, members: bool = True, size: int | None = None) -> Iterator[Found]:
    """All records of a stream, of ``size`` bytes if known, and the gaps between them, in order, without overlap.

    Of a gap only its beginning is kept, so a long one takes no more memory than a short one.

    Records and gaps of one gzip member all have the member's bytes, without overlap in its content. Without
    ``members``, only plain records are looked for.
    """
    window = Window(stream, size)
    starts = STARTS if members else VERSION
    at, gap, problem = 0, -1, ""
    while window.reach(at + 1):
        found, end, failed = [], at, ""
        if members and window.bytes(at, at + 3) == GZIP_MAGIC:
            found, end, failed = members_records(window, at)
        else:
            try:
                found = [parsed(window, at)]
                end = found[0].end
            except Failed as reason:
                failed = str(reason)
        if found:
            if gap >= 0:
                yield Found(gap, at, problem=problem)
                gap = -1
            yield from found
            window.forget(end)
        if failed:
            if gap < 0:
                gap, problem = end, failed
            end = window.find(starts, max(end, at + 1), 10)
            if end < 0:
                break
        at = end
    if gap >= 0:
        while window.more():
            window.forget(window.base + len(window.held))
        yield Found(gap, window.base + len(window.held), problem=problem)


READ = "path string, start bigint, end bigint, inner_start bigint, inner_end bigint, problem string, " \
    "record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string"


def read(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives under ``path``.

    ``problem`` is null for records. A gap has its bytes (``start``, ``end``), the check that failed
    first, and nulls. Inside a gzip member, records and gaps have the member's bytes and their place in its content
    (``inner_start``, ``inner_end``); elsewhere these are null. ``payload_bytes`` and ``payload_digest`` of a response are those of what was
    read; a revisit states its response's. An archive is read by one task, as a stream; a record has to fit
    into memory, and so has the content of a gzip member. Null paths are left out; a path listed twice is read once.
    """
    paths = archives.where("path IS NOT NULL").select("path").distinct()
    spread = paths.repartition(max(1, min(10_000, paths.count())))
    names = [part.strip().split()[0] for part in READ.split(",")] + ["payload"] * with_payload

    def rows(path: str) -> Iterator[tuple]:
        with files.source(path) as stream:
            for found in salvaged(stream, size=stream.size()):
                place = (path, found.start, found.end, found.inner_start, found.inner_end)
                if found.problem:
                    yield (*place, found.problem, *[None] * 6, *[None] * with_payload)
                    continue
                headers, payload = found.headers, payload_of(found)
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if headers["warc-type"] == "revisit":
                    size = http_length(found.block)
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
                yield (*place, None, headers["warc-type"], headers["warc-record-id"],
                       headers.get("warc-target-uri"), headers.get("warc-refers-to"), size, digest,
                       *[payload] * with_payload)

    def work(batches: Batches) -> Batches:
        for part in batches:
            for path in part["path"].to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"") if with_payload else 200
                    if size >= CHUNK * 4:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in held], kinds[i]) for i in range(len(names))], names=names)

    return spread.mapInArrow(work, READ + ", payload binary" * with_payload)


def http_length(block: bytes) -> int | None:
    found = re.search(rb"(?i)^content-length:\s*(\d+)", block.partition(b"\r\n\r\n")[0], re.M)
    return int(found[1]) if found else None


def page_of(column: str) -> F.Column:
    """The page id of a record id made by :func:`urn`."""
    return F.regexp_extract(column, RECORD_URN + r"(-?\d+)>", 1).try_cast("bigint")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
