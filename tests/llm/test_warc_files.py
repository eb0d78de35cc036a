"""Archives that this library didn't write."""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import os
import random
import re
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from driftline.llm import warc
from driftline.llm.common import shared_dir

HTML = b"<html>" + b"x" * 500 + b"</html>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
CHUNKED = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n"


def urn():
    return f"<urn:uuid:{uuid.uuid4()}>"


def record(kind, block, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read(spark, folder):
    return {r.record_id: r for r in warc.read_warc(spark, str(folder)).collect()}


def test_records_of_all_kinds(spark, tmp_path):
    a, b, c, d, dns, big, other = (urn() for _ in range(7))
    message = CHUNKED + warc.chunked(HTML, 100)
    first = [
        record("warcinfo", b"software: x\r\n", WARC_Record_ID=urn()),
        record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID=urn(), Content_Type="application/http; msgtype=request"),
        record("response", HTTP + HTML, WARC_Record_ID=a, WARC_Target_URI="http://a/", WARC_Payload_Digest=sha1(HTML), Content_Type="application/http; msgtype=response"),
        record("response", HTTP + b"other", WARC_Record_ID=b, WARC_Target_URI="http://b/"),
        record("revisit", b"", WARC_Record_ID=c, WARC_Refers_To=a, WARC_Payload_Digest=sha1(HTML)),
        record("response", message, WARC_Record_ID=d, WARC_Payload_Digest=f"sha256:{hashlib.sha256(HTML).hexdigest()}"),
        record("metadata", b"k: v", WARC_Record_ID=urn(), WARC_Refers_To=a),
        record("response", b"20260101 a. 1 IN A 1.2.3.4\n", WARC_Record_ID=dns, Content_Type="text/dns"),
        record("response", message[:200], WARC_Record_ID=big, WARC_Segment_Number=1, WARC_Payload_Digest=sha1(message.partition(b"\r\n\r\n")[2])),
        record("resource", b"ab", WARC_Record_ID=other, WARC_Segment_Number=1),
    ]
    second = [
        record("continuation", message[400:], WARC_Record_ID=urn(), WARC_Segment_Origin_ID=big, WARC_Segment_Number=3, WARC_Segment_Total_Length=len(message)),
        record("continuation", b"cd", WARC_Record_ID=urn(), WARC_Segment_Origin_ID=other, WARC_Segment_Number=2, WARC_Segment_Total_Length=4),
    ]
    third = [record("continuation", message[200:400], WARC_Record_ID=urn(), WARC_Segment_Origin_ID=big, WARC_Segment_Number=2)]
    (tmp_path / "1.warc.gz").write_bytes(b"".join(map(gzip.compress, first)))
    (tmp_path / "2.warc").write_bytes(b"".join(second))
    (tmp_path / "3.warc.gz").write_bytes(gzip.compress(b"".join(third)))
    found = read(spark, tmp_path)
    assert set(found) == {a, b, c, d, dns, big}
    assert all(bytes(found[x].payload) == HTML and found[x].payload_digest == hashlib.sha256(HTML).hexdigest() for x in (a, d, big))
    assert bytes(found[b].payload) == b"other" and found[b].target_uri == "http://b/" and bytes(found[dns].payload).startswith(b"20260101")
    assert found[c].record_type == "revisit" and found[c].refers_to_id == a and found[c].payload is None and found[c].payload_digest == sha1(HTML)
    assert all(r.page_id is None and r.row is None for r in found.values())


@pytest.mark.parametrize(("records", "what"), [
    ([record("response", HTTP + HTML, WARC_Record_ID="<urn:x>", WARC_Payload_Digest=sha1(b"no"))], "<urn:x> hasn't the digest"),
    ([record("response", HTTP, WARC_Record_ID="<urn:x>", WARC_Segment_Number=1)] * 2, "missing or occurs twice"),
    ([record("continuation", b"x", WARC_Record_ID="<urn:y>", WARC_Segment_Origin_ID="<urn:x>", WARC_Segment_Number=2, WARC_Segment_Total_Length=9)], "missing or occurs twice"),
    ([record("response", HTTP, WARC_Record_ID="<urn:x>")[:-3]], "cut short"),
])
def test_damage_is_an_error(spark, tmp_path, records, what):
    (tmp_path / "x.warc").write_bytes(b"".join(records))
    with pytest.raises(Exception, match=what):
        read(spark, tmp_path)


def test_only_other_records(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(record("warcinfo", b"", WARC_Record_ID=urn()))
    assert read(spark, tmp_path) == {}


def test_each_record_is_a_member_of_its_own(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"{k} é" * 30_000) for k in range(5)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    (data,) = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    at, n = 0, 0
    import zlib

    while at < len(data):
        one = zlib.decompressobj(31)
        text = one.decompress(data[at:])
        assert one.eof and len(list(warc.records_in(text))) == 1
        at, n = len(data) - len(one.unused_data), n + 1
    assert n > 5
    found = warc.read_warc(spark, str(tmp_path / "w"))
    assert found.where(F.col("page_id").isNotNull() & (F.col("record_type") == "response")).count() == 5
    with pytest.raises(ValueError, match="16 MB"):
        warc.member(b"x" * (1 << 24))


class Stored(threading.Thread):
    """Sizes of the files that come to be in folders, also of those that Spark's cleaner deletes meanwhile; files under a first name are left out."""

    def __init__(self, *folders):
        super().__init__(daemon=True)
        self.folders, self.done, self.sizes = folders, threading.Event(), {}
        self.before = {path for path, _ in self.found()}

    def found(self):
        for path in (os.path.join(d, x) for folder in self.folders for d, _, names in os.walk(folder) for x in names):
            if not re.search(r"/_temporary/|/temp_|-attempt-", path):
                with contextlib.suppress(FileNotFoundError):
                    yield path, os.path.getsize(path)

    def look(self):
        for path, size in self.found():
            self.sizes[path] = max(size, self.sizes.get(path, 0))

    def run(self):
        while not self.done.wait(0.05):
            self.look()

    def total(self):
        self.done.set()
        self.join()
        self.look()
        return sum(size for path, size in self.sizes.items() if path not in self.before)


def test_payloads_are_exchanged_once_and_archived_once(spark, tmp_path):
    """On disk: the exchange of the writer and the archives, not the payloads of a checkpoint and of the reader's records."""
    draw = random.Random(7)
    pages = [(k, f"http://x/{k}", draw.randbytes(size // 2).hex()) for k, size in enumerate([4_000, 12_000, 40_000] * 100)]
    packed = sum(len(warc._packed(h.encode())) for *_, h in pages)
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    folders = [spark.conf.get("spark.local.dir"), shared_dir(spark).removeprefix("file:"), tmp_path / "w"]
    watch = Stored(*folders)
    watch.start()
    found = warc.warc_roundtrip(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "w"))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in found.collect()} == {(k, len(h), hashlib.sha256(h.encode()).hexdigest(), "response") for k, _, h in pages}
    assert 2 * packed < watch.total() < 2.7 * packed


def test_equal_rows_have_records_of_their_own(spark, tmp_path):
    a, b = "a" * 300, "b" * 300
    rows = [(1, "u", a)] * 3 + [(1, "t", a), (1, None, a), (5, "u", a), (5, "u", a), (None, "u", a), (None, "u", b), (None, "u", b), (None, None, None), (2, "u", "s"), (2, "u", "s")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), str(tmp_path / "w"))
    found = warc.read_warc(spark, str(tmp_path / "w")).collect()
    named = {r.record_id: r for r in found}
    assert len(named) == len(rows)
    told = sorted((str(r.page_id), r.target_uri, r.record_type, r.refers_to or 0) for r in found)
    assert told == sorted((str(i), u or "", *(("revisit", 1) if h == a and i != 1 else ("response", 0))) for i, u, h in rows)
    assert all(named[r.refers_to_id].page_id == 1 and bytes(named[r.refers_to_id].payload) == a.encode() for r in found if r.record_type == "revisit")


def test_segments_in_one_file_or_several(spark, tmp_path):
    """Whole records are made where their file is read; none may go on in another file, or occur there again."""
    message = HTTP + HTML
    head = {"WARC_Record_ID": "<urn:x>", "WARC_Payload_Digest": sha1(HTML)}
    last = record("continuation", message[300:], WARC_Record_ID="<urn:x2>", WARC_Segment_Origin_ID="<urn:x>", WARC_Segment_Number=2, WARC_Segment_Total_Length=len(message))
    begun, alone = record("response", message[:300], **head, WARC_Segment_Number=1), record("response", message, **head)

    def folder(name, *files):
        (tmp_path / name).mkdir()
        for k, data in enumerate(files):
            (tmp_path / name / f"{k}.warc").write_bytes(data)
        return tmp_path / name

    for name, files in {"one": [last + begun], "two": [last, begun], "alone": [alone]}.items():
        found = read(spark, folder(name, *files))
        assert set(found) == {"<urn:x>"} and bytes(found["<urn:x>"].payload) == HTML
    for name, files in {"again": [last + begun, alone], "twice": [alone, alone], "same": [alone * 2], "on": [last + begun, last], "unnumbered": [alone, last]}.items():
        with pytest.raises(Exception, match="missing or occurs twice"):
            read(spark, folder(name, *files))


def test_members_of_a_compressed_archive():
    parts = [b"abc" * 9_999, b"", b"x"]
    assert warc.unzipped(b"\0\0".join(map(gzip.compress, parts)) + b"\0") == b"".join(parts)
    with pytest.raises(EOFError, match="cut short"):
        warc.unzipped(gzip.compress(b"abc") + gzip.compress(b"abc")[:-1])
    with pytest.raises(Exception, match="header"):
        warc.unzipped(gzip.compress(b"abc") + b"junk")
