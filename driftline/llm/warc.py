"""WARC archives written and read by Spark, with segmented records and chunked transfer framing.

Writing: each page becomes an HTTP response in chunked framing. A message longer than ``SEGMENT`` bytes is split into a
response record and continuation records, which name their origin and their number; the last one gives the total
length. A page whose payload an earlier one has becomes a revisit record. Which pages are revisits is found from digests alone; payloads are
exchanged once. Each record is a gzip member of its own, and Spark's text
writer lays them down one after the other: its line separator is the zero byte that ends every member of less than 16 MB.

Reading: archives of any writer are read as binary files and cut into records by their Content-Length. Segments are
grouped by the identifier of their origin, ordered by their number, joined, verified against the total length
and freed of the chunked framing; the payload must have the digest that its record states. What one file holds whole is joined where the file is
read; only segments spread over files are exchanged, and of the others their identifiers, none of which may occur again. Records other than responses, revisits and their continuations are passed over.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import cut, remove, salted_lookup, shared_dir, table

SEGMENT = 16_384
CHUNK = 4_096
RECORDS_PER_FILE = 1_000
#: Smaller payloads are written in full however often they occur.
LEAST_REVISIT = 100
END = "\r\n\r\n"
#: Bytes of payload, and rows, that tasks hand on at once.
BATCH_BYTES = 1 << 20
BATCH_ROWS = 1_000
#: Bytes of an archive that are unpacked at once.
PIECE = 8_192
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(x := payload[k : k + size]), x) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, block: bytes, headers: list[tuple[str, object]]) -> bytes:
    """One WARC record without the two CRLFs that end it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 2026-01-01T00:00:00Z", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END.encode() + block


def record_id(page_id: int | None, row: int, mark: str = "") -> str:
    """The identifier of a page's record; rows that share a page_id, or have none, are told apart by their mark, equal rows by their number."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{mark and mark + ':'}{row}>"


def page_records(
    page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_row: int | None, segment: int = SEGMENT, mark: str = "", refers_mark: str = ""
) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations."""
    name = record_id(page_id, row, mark)
    shown = re.sub(r"[\r\n]", "", url or "")
    common = [("WARC-Target-URI", shown), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", b"", [("WARC-Record-ID", name), ("WARC-Refers-To", record_id(refers_to, refers_row, refers_mark)), ("WARC-Profile", profile), *common])
        return
    message = _HTTP + chunked(payload)
    parts = [message[k : k + segment] for k in range(0, len(message), segment)]
    for k, part in enumerate(parts, 1):
        numbered = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
        if k == 1:
            yield record("response", part, [("WARC-Record-ID", name), *numbered, *common])
        else:
            total = [("WARC-Segment-Total-Length", len(message))] if k == len(parts) else []
            yield record("continuation", part, [("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", name), *numbered, *total, *common])


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(END.encode(), at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        if len(data) < start + size + 4 or data[start + size : start + size + 4] != END.encode():
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, data[start : start + size]
        at = start + size + 4


def member(record_: bytes) -> bytes:
    """A record and the two CRLFs that end it as a gzip member, without its last byte: the highest one of its size, which is zero."""
    found = gzip.compress(record_ + END.encode(), compresslevel=6, mtime=0)
    if found[-1]:
        raise ValueError("a record of 16 MB or more can't be written: take shorter segments")
    return found[:-1]


def unzipped(archive: bytes) -> bytes:
    """The content of a gzip file of any number of members, which may have zero bytes between them. They are fed in short pieces: what follows a member is copied."""
    out, at, view = [], 0, memoryview(archive)
    while at < len(archive):
        one = zlib.decompressobj(31)
        while not one.eof:
            if at == len(archive):
                raise EOFError("a compressed archive is cut short")
            piece = view[at : at + PIECE]
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        while at < len(archive) and not archive[at]:
            at += 1
    return b"".join(out)


def states_digest(stated: str | None, body: bytes, payload: bytes) -> bool:
    """Whether a stated digest is that of the payload, or of the body as it was sent; of algorithms other than SHA-1 and SHA-256 nothing is known."""
    name, _, value = (stated or "").partition(":")
    make = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256}.get(name.strip().lower())
    if make is None:
        return True
    digests = (make(x).digest() for x in (payload, body))
    return any(value.strip().lower() in (d.hex(), base64.b32encode(d).decode().lower().rstrip("="), base64.b32encode(d).decode().lower()) for d in digests)


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """Joins the (number, total length, block) of one record's segments, whatever their order."""
    parts = sorted(segments, key=lambda x: x[0])
    if [k for k, _, _ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or occurs twice")
    message = b"".join(x for _, _, x in parts)
    if len(parts) > 1 and parts[-1][1] != len(message):
        raise ValueError("the segments don't have the total length that the last one states")
    return message


def body_and_payload(message: bytes) -> tuple[bytes, bytes]:
    """The body of an HTTP response as it was sent, and freed of its framing."""
    head, _, body = message.partition(END.encode())
    return body, dechunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked", head) else body


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP response."""
    return body_and_payload(message)[1]


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def classified(pages: DataFrame) -> DataFrame:
    """(mark, page_id, url, packed, digest, copies, refers_to, refers_mark): compressed payloads, their digests, and the page whose payload each repeats.

    A row stands for ``copies`` pages that are equal in page_id, url and payload; its mark is a hash of the three. So the page that others
    refer to is named by what it holds, whatever the order in which Spark reads rows. ``pages`` are read twice: for digests and marks, which are
    checkpointed, and for payloads, which pass one exchange, by mark, where they meet what was found for it.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = pa.array([_packed(x.as_py()) for x in part["html"]], pa.binary())
                yield pa.RecordBatch.from_arrays([part["mark"], part["page_id"], part["url"], part["digest"], packed], names=["mark", "page_id", "url", "digest", "packed"])

    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("url", "html")))
    told = texts.withColumn("html", F.col("html").cast("binary")).withColumn("digest", F.sha2("html", 256))
    told = told.withColumn("mark", F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest", "url"), 256), 1, 32))

    large = told.where(F.octet_length("html") >= LEAST_REVISIT).select("mark", "page_id", F.unhex("digest").alias("digest"))
    known = cut(large.groupBy("mark", "page_id", "digest").agg(F.count(F.lit(1)).alias("n")))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "mark"))
    firsts = known.groupBy("digest").agg(F.min(named).alias("first"), F.sum("n").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("first.page_id") != F.col("page_id")))
    found = salted_lookup(known, firsts, ["digest"], "mark").where(again).select("mark", F.col("first.page_id").alias("refers_to"), F.col("first.mark").alias("refers_mark"))

    packed = told.select("mark", "page_id", "url", "digest", "html").mapInArrow(described, "mark string, page_id long, url string, digest string, packed binary")
    rows = packed.groupBy("mark").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("page_id", "url", "digest", "packed")))
    return rows.join(found, "mark", "left")


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes ``pages`` (page_id, url, html) as compressed WARC files to the folder ``path``, which all executors reach.

    A null html is an empty payload. Of equal payloads of 100 bytes or more, all pages but those of the smallest page_id
    are revisits. Rows that repeat a page_id, or have none, have record identifiers of their own; the records of rows equal in page_id, url and html are
    written by one task. A payload may be of any length that fits a
    task: it is written in segments. An empty table gives no records; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records, size = [], 0
            for k in range(batch.num_rows):
                x = {name: batch[name][k].as_py() for name in ("mark", "page_id", "url", "digest", "refers_to", "refers_mark")}
                payload = _unpacked(batch["packed"][k].as_py())
                for copy in range(batch["copies"][k].as_py()):
                    records.extend(map(member, page_records(payload=payload, row=copy, refers_row=0, **x, segment=segment)))
                    size += len(payload)
                    if size >= BATCH_BYTES or len(records) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])
                        records, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])

    written = classified(pages).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


#: Kinds of records that a reader takes in; other ones are known by "other", so that their continuations can be told.
TAKEN = ("response", "revisit", "continuation")
RECORD = "record_id string, target_uri string, page_id long, row long, record_type string, payload binary, payload_digest string, refers_to_id string, refers_to long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of a folder of WARC files, segments reassembled, a row each.

    The columns are record_id, target_uri, page_id and row (of files written by ``write_warc``; null else), record_type, payload (null for revisits), payload_digest
    (the payload's SHA-256 in hexadecimal; of a revisit as it is stated), refers_to_id, and refers_to, its page. Files may be compressed, whole or a record each, or not. Segments may lie in several
    files; they are grouped by WARC-Segment-Origin-ID, and by WARC-Record-ID where a record has none. A record without WARC-Segment-Number is whole, as the format has it. A record that is cut short, lacks a segment, occurs
    twice, or whose payload hasn't the stated length or digest is an error. A response that isn't HTTP is its own payload. A file is read by one task, twice:
    for the records that it holds whole, and for the segments that others go on with. A folder without records gives an empty result.
    """
    names = ["origin", "whole", "kind", "segment", "total", "uri", "refers", "digest", "http", "block"]
    kinds = (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary())

    def own(name: str | None) -> tuple[int | None, int | None]:
        """Page and row of an identifier that ``record_id`` made."""
        found = re.fullmatch(r"<urn:page:(-?\d+|null):(?:[0-9a-f]{32}:)?(\d+)>", name or "")
        return (None if found[1] == "null" else int(found[1]), int(found[2])) if found else (None, None)

    def origins(archive: bytes) -> Iterator[tuple[bool, list[dict]]]:
        """The segments of each origin in a file, and whether they are all there: records that aren't segmented as they come, the others at the end."""
        parts: dict[str, list[dict]] = {}
        for h, block in records_in(unzipped(archive) if archive[:2] == b"\x1f\x8b" else archive):
            kind, total = h["warc-type"].lower(), h.get("warc-segment-total-length")
            if kind not in TAKEN:
                if "warc-segment-number" not in h:
                    continue
                kind, block = "other", b""
            alone = kind != "continuation" and not {"warc-segment-number", "warc-segment-origin-id"} & h.keys()
            x = {"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "kind": kind, "segment": int(h.get("warc-segment-number", 1)), "total": None if total is None else int(total)}
            x |= {"uri": h.get("warc-target-uri"), "refers": h.get("warc-refers-to"), "digest": h.get("warc-payload-digest")}
            x |= {"http": h.get("content-type", "application/http").lower().startswith("application/http"), "block": block if alone else _packed(block)}
            if alone:
                yield True, [x]
            else:
                parts.setdefault(x["origin"], []).append(x)
        for found in parts.values():
            found.sort(key=lambda x: x["segment"])
            numbers, head = [x["segment"] for x in found], [x["kind"] for x in found if x["kind"] != "continuation"]
            yield head == ["response"] and numbers == list(range(1, len(found) + 1)) and found[-1]["total"] is not None, [x | {"block": _unpacked(x["block"])} for x in found]

    def row_of(segments: list[dict]) -> tuple | None:
        """A row of the result from the segments of one origin; None for a record that is passed over."""
        first = {x["kind"] for x in segments} - {"continuation"}
        if "other" in first:
            return None
        x = next((x for x in segments if x["kind"] != "continuation"), segments[0])
        page, row = own(x["origin"])
        if "revisit" in first:
            return (x["origin"], x["uri"], page, row, "revisit", None, (x["digest"] or "").removeprefix("sha256:") or None, x["refers"], own(x["refers"])[0])
        message = reassembled([(s["segment"], s["total"], s["block"]) for s in segments])
        body, payload = body_and_payload(message) if x["http"] else (message, message)
        if not states_digest(x["digest"], body, payload):
            raise ValueError(f"the payload of {x['origin']} hasn't the digest that its record states")
        return (x["origin"], x["uri"], page, row, "response", payload, hashlib.sha256(payload).hexdigest(), None, None)

    def batched(found: Iterator[tuple | None]) -> Iterator[pa.RecordBatch]:
        """Rows of the result by the megabyte."""
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64())
        told = [x.split()[0] for x in RECORD.split(", ")]

        def together(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=told)

        rows, size = [], 0
        for x in found:
            if x is not None:
                rows.append(x)
                size += len(x[5] or b"")
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield together(rows)
                rows, size = [], 0
        yield together(rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records that a file holds whole."""
        yield from batched(row_of(found) for batch in batches for data in batch["content"] for done, found in origins(data.as_py()) if done)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other segments, and the identifiers of whole records."""

        def columns(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for data in batch["content"]:
                rows, size = [], 0
                for done, found in origins(data.as_py()):
                    for x in found[:1] if done else found:
                        rows.append((x["origin"], True, *[None] * 8) if done else (x["origin"], False, *(x[c] for c in names[2:-1]), _packed(x["block"])))
                        size += len(rows[-1][-1] or b"")
                        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield columns(rows)
                            rows, size = [], 0
                yield columns(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple | None]:
            for batch in batches:
                for k in range(batch.num_rows):
                    x = {name: batch[name][k].as_py() for name in batch.schema.names}
                    if x["wholes"]:
                        raise ValueError(f"{x['origin']}: a segment is missing or occurs twice")
                    told = {c: x[c] for c in ("origin", "uri", "refers", "digest", "http")}
                    yield row_of([told | s | {"block": _unpacked(s["block"])} for s in x["segments"]])

        yield from batched(rows())

    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(rest, "origin string, whole boolean, kind string, segment int, total long, uri string, refers string, digest string, http boolean, block binary")
    head = ~F.col("whole") & (F.col("kind") != "continuation")
    told = [F.max(F.when(head, F.col(c))).alias(c) for c in ("uri", "refers", "digest", "http")]
    segments = F.sort_array(F.collect_list(F.when(~F.col("whole"), F.struct("segment", "kind", "total", "block")))).alias("segments")
    grouped = records.groupBy("origin").agg(segments, F.count_if("whole").alias("wholes"), *told).where("wholes <> 1 OR size(segments) > 0")
    return files.mapInArrow(whole, RECORD).unionByName(grouped.mapInArrow(joined, RECORD))


def warc_roundtrip(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``pages`` to ``path`` and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``payload_bytes`` and ``payload_digest`` are of the full payload; a revisit has the length of the response that it
    refers to, which must have its digest. Pages of a null page_id come back as such. An empty table gives an empty result.
    """
    write_warc(pages, path)
    found = read_warc(pages.sparkSession, path)
    records = cut(found.select("page_id", F.xxhash64("record_id").alias("spread"), "record_type", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "refers_to"))
    full = records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("n").alias("full_n"))
    revisits = salted_lookup(records.where("record_type = 'revisit'"), full, ["refers_to", "payload_digest"], "spread")
    length = F.when(F.col("full_n").isNull(), F.raise_error("a revisit refers to no response of its digest").cast("long")).otherwise(F.col("full_n"))
    whole = records.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return whole.unionByName(revisits.select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC archives to the shared folder and read back; the archives are deleted then."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    found = warc_roundtrip(table(spark, sf_dir, "pages"), path)  # rests on a checkpoint of what was read
    remove(spark, path)
    return found


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
