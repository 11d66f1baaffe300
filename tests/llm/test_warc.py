import gzip
import hashlib
import io
import random

import pytest

from hirelake.llm import files, warc


def records(n, seed=23):
    drawn = random.Random(seed)
    payloads = [drawn.randbytes(drawn.randrange(3000)) + b"WARC/1.1\r\n" * (i % 5 == 0) + b"\r\n\r\n" for i in range(n)]
    return [warc.record(i, f"http://x.net/{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]


def ids(found):
    return [f.headers["warc-record-id"] for f in found if not f.problem]


def parts_of(n, packed):
    return [gzip.compress(r, 4, mtime=0) if packed else r for r in records(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_sound_archives(packed):
    found = list(warc.salvaged(io.BytesIO(b"".join(parts_of(50, packed)))))
    assert ids(found) == [warc.urn(i) for i in range(50)] and not any(f.problem for f in found)
    assert [f.end for f in found[:-1]] == [f.start for f in found[1:]]
    assert list(warc.salvaged(io.BytesIO(b""))) == []


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_no_other_record(packed):
    """Whatever happens to some records, the others come back and the gaps cover just the bytes between."""
    drawn = random.Random(24)
    for _ in range(60):
        parts = parts_of(12, packed)
        hurt = set(drawn.sample(range(12), drawn.randint(1, 4)))
        seen = packed
        for i in hurt:
            way = drawn.randrange(4)
            seen |= way in (0, 2)  # other bytes in a plain header may pass
            at = drawn.randrange(40, len(parts[i]) - 10)
            if way == 0:
                parts[i] = parts[i][:at]
            elif way == 1:
                parts[i] = parts[i][:at] + bytes([parts[i][at] ^ 0x55]) + parts[i][at + 1:]
            elif way == 2:
                parts[i] = drawn.randbytes(60) + parts[i][5:]
            else:
                parts[i] = parts[i][:at] + drawn.randbytes(30) + parts[i][at:]
        data = b"".join(parts)
        found = list(warc.salvaged(io.BytesIO(data)))
        assert set(ids(found)) >= {warc.urn(i) for i in range(12) if i not in hurt}
        covered = sorted((f.start, f.end) for f in found)
        assert covered[0][0] == 0 and covered[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        assert not seen or any(f.problem for f in found)


def test_gaps_name_the_failed_check():
    whole = records(1)[0]
    cases = {
        "no version line": b"junk" + whole,
        "record is cut off": whole[:-9],
        "header line without a name": whole.replace(b"WARC-Date:", b"WARC-Date", 1).replace(b"Date 2024-01-01T00:00:00Z", b"Date", 1),
        "no content length": whole.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 2),
        "no warc-date": whole.replace(b"WARC-Date", b"WARC-Data"),
        "block digest differs": whole.replace(b"HTTP/1.1 200", b"HTTP/1.1 404"),
        "record does not end where it should": whole[:-4] + b"\n\n\n\n",
    }
    for problem, data in cases.items():
        found = list(warc.salvaged(io.BytesIO(data)))
        assert [f.problem for f in found if f.problem] == [problem], problem
    packed = gzip.compress(whole)
    assert [f.problem for f in warc.salvaged(io.BytesIO(packed[:-20]))] == ["member is cut off"]
    assert [f.problem for f in warc.salvaged(io.BytesIO(packed[:-6] + b"\0\0\0\0\0\0"))] == ["member does not unpack"]
    assert ids(warc.salvaged(io.BytesIO(b"junk" + packed + b"tail"))) == [warc.urn(0)]


def test_chunk_borders(monkeypatch):
    data = b"".join(parts_of(20, True)) + b"junk" + b"".join(parts_of(20, False))
    for chunk in (1, 7, 1000):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        monkeypatch.setattr(warc, "FEED", 5)
        assert len(ids(warc.salvaged(io.BytesIO(data)))) == 40


def test_damage_inside_a_member():
    """Many records in one member: one that fails costs no other, and its inner gap is logged."""
    parts = records(30)
    content = b"".join(parts)
    marks = [sum(map(len, parts[:i])) for i in range(31)]
    hurt = content[:marks[7] + 600] + b"?" + content[marks[7] + 601:]
    packed, tail = gzip.compress(hurt, 4, mtime=0), gzip.compress(parts[0], 4, mtime=0)
    found = list(warc.salvaged(io.BytesIO(packed + tail)))
    assert ids(found) == [warc.urn(i) for i in range(30) if i != 7] + [warc.urn(0)]
    assert [(f.start, f.end, f.inner_start, f.inner_end, f.problem) for f in found if f.problem] == \
        [(0, len(packed), marks[7], marks[8], "block digest differs")]
    assert [(f.inner_start, f.inner_end) for f in found[:30]] == list(zip(marks, marks[1:]))
    assert (found[-1].start, found[-1].end) == (len(packed), len(packed + tail))


@pytest.mark.parametrize("feed", [7, 1 << 14])
def test_damaged_member_of_many_records(monkeypatch, feed):
    """A cut, a wrong checksum and damaged packing: the sound records before come back, the rest is one gap."""
    monkeypatch.setattr(warc, "FEED", feed)
    parts = records(30)
    packed, tail = gzip.compress(b"".join(parts), 4, mtime=0), gzip.compress(records(31)[30], 4, mtime=0)
    for data, least, problem in ((packed[:len(packed) // 2], 10, "member is cut off"),
                                 (packed[:-8] + b"\0" * 8 + tail, 30, "member does not unpack"),
                                 (packed[:len(packed) // 2] + tail, 10, "member does not unpack"),
                                 (packed[:len(packed) // 2] + b"\xff" * 99 + packed[len(packed) // 2 + 99:] + tail, 10,
                                  "member does not unpack")):
        found = list(warc.salvaged(io.BytesIO(data)))
        names = [f.headers["warc-record-id"] for f in found if not f.problem and f.start == 0]
        assert names == [warc.urn(i) for i in range(len(names))] and len(names) >= least
        gap = next(f for f in found if f.problem)
        assert gap.problem == problem and gap.start == found[0].end and len([f for f in found if f.problem]) == 1
        if data.endswith(tail):
            assert ids(found)[-1] == warc.urn(30) and gap.end == found[-1].start == len(data) - len(tail)
        else:
            assert gap.end == len(data)
    bare = b"".join(parts).replace(b"WARC-Block-Digest", b"WARC-Other-Digest")
    packed = gzip.compress(bare, 4, mtime=0)
    assert len(ids(warc.salvaged(io.BytesIO(packed)))) == 30
    assert ids(warc.salvaged(io.BytesIO(packed[:-8] + b"\0" * 8))) == []  # nothing vouches for the blocks
    assert ids(warc.salvaged(io.BytesIO(packed[:-8]))) == [warc.urn(i) for i in range(30)]


def test_inner_gaps_in_files(spark):
    pages = spark.createDataFrame([(1, "http://a/", "page")], "page_id int, url string, html string")
    path = warc.write(pages).first()["path"].replace(".warc.gz", "-whole.warc.gz")
    parts = records(5)
    with files.output(path) as stream:
        stream.write(gzip.compress(parts[0] + parts[1][:-9] + b"".join(parts[2:])))
    got = warc.read(spark, spark.createDataFrame([(path,)], "path string"))
    assert {r["record_id"] for r in got.where("problem IS NULL").collect()} == {warc.urn(i) for i in (0, 2, 3, 4)}
    assert [(r["start"], r["inner_start"], r["inner_end"]) for r in got.where("problem IS NOT NULL").collect()] == \
        [(0, len(parts[0]), len(parts[0] + parts[1]) - 9)]


@pytest.mark.parametrize("compressed", [True, False])
def test_pages(spark, compressed):
    long = "long enough to be stored once only " * 5
    rows = [(5, "http://a/", long), (3, "http://b/", long), (9, None, long), (None, "http://c/", long), (4, "u\r\nX: y", "short"),
            (6, "http://d/", "short"), (7, "http://e/", None), (8, "http://f/", ""), (3, "http://b/", long),
            (10, "http://g/", "WARC/1.1\r\n\r\n" * 9_000 + "é")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")
    archives = warc.write(pages, compressed=compressed, file_bytes=2000)
    got = warc.read(spark, archives).withColumns({"page_id": warc.page_of("record_id"), "to": warc.page_of("refers_to")}).collect()
    assert all(r["problem"] is None for r in got) and len(got) == len(rows)
    wanted = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        refers = 3 if html == long and page_id != 3 else None
        wanted.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers,
                       None if refers else data))
    assert sorted(map(repr, wanted)) == sorted(
        repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["to"],
              None if r["record_type"] == "revisit" else bytes(r["payload"]))) for r in got)
    assert {r["target_uri"] for r in got if r["page_id"] == 4} == {"u%0D%0AX:%20y"}
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_gaps_in_files(spark):
    pages = spark.createDataFrame([(i, "http://a/", f"page {i}") for i in range(5)], "page_id int, url string, html string")
    path = warc.write(pages.coalesce(1)).first()["path"]
    with files.source(path) as stream:
        data = stream.read()
    marks = [f.start for f in warc.salvaged(io.BytesIO(data))]
    broken = path.replace(".warc.gz", "-broken.warc.gz")
    with files.output(broken) as stream:
        stream.write(data[:marks[2]] + b"?" * 10 + data[marks[2] + 10:])
    listed = spark.createDataFrame([(broken,), (broken,), (None,)], "path string")
    got = warc.read(spark, listed, with_payload=False)
    assert got.where("problem IS NULL").count() == 4
    assert [(r["start"], r["end"], r["problem"]) for r in got.where("problem IS NOT NULL").collect()] == \
        [(marks[2], marks[3], "no version line")]


class Endless:
    """A stream of so many bytes of junk, then a record; counts what it gave."""

    def __init__(self, size, tail, junk=b"x"):
        self.left, self.tail, self.junk = size, tail, junk

    def read(self, n):
        if self.left:
            made = (self.junk * (n // len(self.junk) + 1))[:min(n, self.left)]
            self.left -= len(made)
            return made
        data, self.tail = self.tail, b""
        return data


def peak(stream, size=None):
    import tracemalloc

    tracemalloc.start()
    found = list(warc.salvaged(stream, size=size))
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, top


def test_a_long_gap_is_not_held():
    record = warc.record(1, "http://a/", b"payload", warc.hashlib.sha256(b"payload").hexdigest(), None)
    found, top = peak(Endless(100 << 20, record))
    assert [(f.start, f.end, bool(f.problem)) for f in found] == [(0, 100 << 20, True), (100 << 20, (100 << 20) + len(record), False)]
    assert top < 8 * warc.CHUNK


def test_a_length_beyond_the_file_reads_nothing_more():
    record = warc.record(1, "http://a/", b"payload", warc.hashlib.sha256(b"payload").hexdigest(), None)
    bad = warc.re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 99999999999\r\n\r\nHTTP", record)
    assert bad != record
    tail = bytes(50 << 20)
    found, top = peak(Endless(0, bad + tail + record), size=len(bad) + len(tail) + len(record))
    assert [bool(f.problem) for f in found] == [True, False]


def test_false_beginnings_read_a_header_once():
    import time

    junk = b"WARC/1.0\r\nx"
    start = time.perf_counter()
    found, _ = peak(Endless(1 << 20, b"\r\n\r\n", junk))
    assert len(found) == 1 and time.perf_counter() - start < 20
