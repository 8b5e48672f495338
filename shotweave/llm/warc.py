"""WARC archives of pages: written in segments with chunked transfer framing, read back by joining the segments.

Writing: a page becomes an HTTP response in a WARC/1.1 record whose block has at most ``segment_bytes`` bytes; what is
longer goes on in continuation records that name the first record (WARC-Segment-Origin-ID), count up
(WARC-Segment-Number) and end with WARC-Segment-Total-Length. A page whose payload another page has already is a revisit:
headers alone, and the response that has the payload (WARC-Refers-To). Spark's text writer stores the records, so the
archives can lie wherever Spark can write.

Reading: Spark's text reader splits archives at record heads, so a large file is read by many tasks. Records in one
segment are decoded where they are read; only segments move, to their origin's group, are put in order, checked against
the total length, and joined. Then the chunked framing is taken off and the payload is checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.shared import new_path, remove, written

#: Most bytes of a record's block; pages of more are written in several segments.
SEGMENT_BYTES = 32 * 1024
#: Most bytes of a chunk of the transfer framing.
CHUNK_BYTES = 8 * 1024
#: WARC-Date of all records, as pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"

#: What begins a record, with a line end. Nothing that is written has it elsewhere, so that readers can split there; it
#: can't overlap itself, which Spark's reader needs of a separator to find it across its buffers.
_VERSION = b"WARC/1.1"
_HEAD = _VERSION + b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_SAFE = re.compile(r"[\x00-\x20\x7f-\x9f]")

_RECORD = "record_id string, type string, page_id long, uri string, refers_to_id string, digest string, origin_id string, segment int, total_length long, block binary"
_CAPTURE = "record_id string, type string, page_id long, uri string, refers_to_id string, digest string, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format: lengths, segments, framing or digests don't agree."""


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk ends early inside anything that looks like the head of a record."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        mark = payload.find(_VERSION, at, end)
        if mark >= 0:
            end = mark + 1  # the framing then stands between its first letter and the rest
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailer fields are passed over."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        size = framed[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise WarcError(f"no chunk size at byte {at}")
        n, at = int(size, 16), end + 2
        if not n:
            if not (framed[at:at + 2] == b"\r\n" or framed.endswith(b"\r\n\r\n")):
                raise WarcError("the last chunk has no end")
            return b"".join(out)
        out.append(framed[at:at + n])
        if len(out[-1]) != n or framed[at + n:at + n + 2] != b"\r\n":
            raise WarcError(f"a chunk of {n} bytes is cut at byte {at}")
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, its transfer framing taken off."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("an HTTP message without end of headers")
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return dechunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record up to, but without, the two line ends that close it. Fields that are None are left out."""
    lines = [f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return b"".join([_HEAD, *lines, b"\r\n", block])


def page_records(row: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: one response, several segments of one, or a revisit."""
    uri = _SAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), row["url"] or "").replace("WARC/", "WARC%2F")
    about = [("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE), ("WARC-Target-URI", uri or None), ("WARC-Page-ID", row["page_id"]),
             ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("Content-Type", "application/http;msgtype=response")]
    if row["record_id"] != row["first_id"]:
        yield record([("WARC-Type", "revisit"), *about, ("WARC-Refers-To", row["first_id"]), ("WARC-Profile", _PROFILE)], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"], chunk_bytes)
    parts = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    number = 1 if len(parts) > 1 else None
    yield record([("WARC-Type", "response"), *about, ("WARC-Segment-Number", number)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        own = _urn(f"{row['record_id']} {k}")
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", row["record_id"]),
                      ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)], part)


def _urn(text: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(text.encode()).hexdigest())}>"


def _write_batches(segment_bytes: int, chunk_bytes: int):
    """Records of the pages of a task, which has all copies of a row that is repeated; the first of these keeps the row's own id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                mark = row["uid"]
                if (row["copies"] or 1) > 1:
                    k = seen[mark] = seen.get(mark, -1) + 1
                    mark += f" {k}" if k else ""
                row |= {"record_id": _urn(mark), "first_id": _urn(row["first_uid"] or mark)}
                for r in page_records(row, segment_bytes, chunk_bytes):
                    out.append(r + b"\r\n\r")  # the writer adds the last line end
                    size += len(r)
                if size > 1 << 22:
                    yield pa.record_batch({"record": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield pa.record_batch({"record": pa.array(out, pa.binary())})
    return run


def _captured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = [b if b is not None else b"" for b in batch.column("payload").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(html, pa.binary())).append_column(
            "digest", pa.array([payload_digest(b) for b in html], pa.string()))


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, min_revisit: int = 0) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to archives in the folder ``path``.

    The payload is the html in UTF-8; a null is empty. Of rows with equal payloads of at least ``min_revisit`` bytes one
    with the smallest page_id is the response (a null page_id comes last; of repeated rows one), and the others revisit it.
    Payloads are equal if length, SHA-1 and SHA-256 are. Who revisits whom is found on digests. Payloads stay with
    the tasks that read them unless the table of what is told of pages is too large to broadcast; then they move once, spread
    by row and not by payload, so that pages that are all alike don't meet.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    captures = (rows.mapInArrow(_captured, "page_id long, url string, payload binary, digest string")
                .withColumn("same", F.concat_ws(" ", F.octet_length("payload").cast("string"), "digest", F.sha2("payload", 256)))
                .withColumn("uid", F.sha2(F.to_json(F.struct("page_id", "url", "same")).cast("binary"), 256)))
    known = written(captures.filter(F.octet_length("payload") >= min_revisit).groupBy("uid", "page_id", "same").agg(F.count("*").alias("copies")), "captures")
    least = F.min(F.struct(F.col("page_id").isNull(), "page_id", "uid"))
    firsts = known.groupBy("same").agg(least.alias("least"), F.sum("copies").alias("n")).filter("n > 1")  # the payload of one row meets nothing
    told = written(known.join(firsts.select("same", F.col("least.uid").alias("first_uid")), "same").select("uid", "first_uid", "copies"), "told")
    marked = captures.drop("same").join(told, "uid", "left")  # told is a table of known size: broadcast while small
    if not told.filter("copies > 1").isEmpty():  # copies of a row meet in the task that tells them apart
        repeated = F.col("copies").isNotNull() & (F.col("copies") > 1)
        marked = marked.filter(~repeated).unionByName(marked.filter(repeated).repartition("uid"))
    out = marked.mapInArrow(_write_batches(segment_bytes, chunk_bytes), "record binary")
    out.select(F.col("record").cast("string")).write.option("lineSep", "\n").text(path)


_KEPT_TYPES = {"response", "resource", "revisit", "continuation"}


def parse(piece: bytes) -> tuple[dict, int]:
    """Fields and block of a record without its first line, and how many bytes of the block are missing."""
    head, gap, rest = piece.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
    length = fields.get("content-length", "")
    if not gap or not length.isdigit() or rest[int(length):].strip(b"\r\n"):
        raise WarcError(f"a record's block doesn't have its Content-Length: {fields.get('warc-record-id')}")
    return fields | {"block": rest[:int(length)]}, int(length) - len(rest)


def records_of(pieces: Iterator[bytes], head: bytes) -> Iterator[dict]:
    """Records from what stands between heads. A block that holds a head itself goes on in the next piece."""
    held = None
    for piece in pieces:
        if held is None and not piece.strip(b"\r\n"):  # before the first record
            continue
        held = piece if held is None else held + head + piece
        found, missing = parse(held)
        if missing <= 0:
            yield found
            held = None
    if held is not None:
        raise WarcError("an archive, or a part of one that is read alone, ends within a record")


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _read_batches(head: bytes):
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to_id", pa.string()),
                        ("digest", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])

    def row(r: dict) -> dict:
        segment = _number(r.get("warc-segment-number"))
        return {"record_id": r["warc-record-id"], "type": r["warc-type"], "page_id": _number(r.get("warc-page-id")), "uri": r.get("warc-target-uri"),
                "refers_to_id": r.get("warc-refers-to"), "digest": r.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                "origin_id": r.get("warc-segment-origin-id") or (r["warc-record-id"] if segment else None), "segment": segment,
                "total_length": _number(r.get("warc-segment-total-length")), "block": r["block"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r in records_of((p for batch in batches for p in batch.column(0).to_pylist()), head):
            if r.get("warc-type") in _KEPT_TYPES:
                rows.append(row(r))
                size += len(r["block"])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for kind, digest, block in zip(batch.column("type").to_pylist(), batch.column("digest").to_pylist(), batch.column("block").to_pylist()):
            payload = None if kind == "revisit" else http_payload(block)
            if payload is not None and digest and payload_digest(payload) != digest:
                raise WarcError(f"a payload doesn't have its digest {digest}")
            out.append(payload)
        yield batch.set_column(batch.schema.get_field_index("block"), "payload", pa.array(out, pa.binary()))


def read_records(spark: SparkSession, path: str, version: str = _VERSION.decode()) -> DataFrame:
    """One row per record of the archives: fields, block, and where segmented the origin and the segment's number.

    A payload with a record's head inside, as other writers make them, is put together again by its Content-Length where
    one task reads all of it; else reading raises.
    """
    head = f"{version}\r\n"
    pieces = spark.read.option("lineSep", head).text(path)
    return pieces.select(F.col("value").cast("binary")).mapInArrow(_read_batches(head.encode()), _RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Segments joined: groups by origin, in the order of their numbers. A group is one capture, so it has a record's size.

    Raises where numbers aren't 1 to n, the origin or the last segment is missing, or the total length isn't that of all.
    """
    block = F.array_join(F.transform("parts", lambda p: p.block.cast("string")), "").cast("binary")  # bytes as they are
    whole = (records.filter("origin_id is not null").groupBy("origin_id")
             .agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total_length").alias("total_length"), F.max("segment").alias("last"),
                  F.max(F.when(F.col("type") != "continuation", F.struct("type", "page_id", "uri", "refers_to_id", "digest"))).alias("head"))
             .withColumn("block", block))
    numbers = F.transform("parts", lambda p: p.segment)
    right = ((F.col("total_length") == F.octet_length("block")) & (numbers == F.sequence(F.lit(1), F.col("last"))) & F.col("head").isNotNull())
    checked = F.when(F.coalesce(right, F.lit(False)), F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("segments of a record are missing or don't have its total length: "), "origin_id")).cast("binary"))
    return whole.select(F.col("origin_id").alias("record_id"), "head.*", checked.alias("block"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives: record_id, type, page_id, uri, refers_to_id, digest, payload (null for a revisit)."""
    records = read_records(spark, path)
    names = ["record_id", "type", "page_id", "uri", "refers_to_id", "digest", "block"]
    alone = records.filter("origin_id is null").select(*names)
    joined = reassembled(records).select(*names)
    return alone.mapInArrow(_decoded, _CAPTURE).unionByName(joined.mapInArrow(_decoded, _CAPTURE))


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, min_revisit: int = 0) -> DataFrame:
    """Write ``pages`` as archives to the shared folder, read them back, and report every page.

    Columns: page_id, payload_bytes and payload_digest (of the full payload, for revisits that of the response they refer
    to), record_type, refers_to (page_id of the response, null for responses). One row per row of ``pages``, repeated rows
    included; other columns are left alone; an empty table gives no rows. A revisit without its response is an error.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, segment_bytes, chunk_bytes, min_revisit)
    digests = written(read(spark, path).select("record_id", "type", "page_id", "refers_to_id", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "captures")
    remove(spark, path)
    own = digests.filter("type <> 'revisit'")
    there = own.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    back = digests.filter("type = 'revisit'").drop("payload_bytes").join(there, "refers_to_id", "left")
    found = F.when(F.col("_digest") == F.col("digest"), F.col("_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response with the payload of revisit "), "record_id")).cast("long"))
    return own.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        back.select("page_id", found.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"))
