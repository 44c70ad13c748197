"""WARC archives: writing through Spark's text sink, and a reader that salvages damaged files.

Writing. A record is text (UTF-8 payload, ASCII headers) that ends in CR LF CR
LF, so Spark's text sink with CR LF as line end writes exact archives; tasks
commit their files as always, and lost executors leave no broken ones.

Reading. Each file is walked member by member (gzip) or record by record
(plain). A record is accepted when its version line, header block, length, end
mark and payload digest are right. When a check fails, the reader searches for
the next gzip member or ``WARC/`` version line whose record passes, and the
bytes between are logged as a gap. Files are read whole by a task; the writer
ends a file at the number of records that makes about ``FILE_BYTES``.

Results in odd cases: a null payload is the empty payload; null or blank
addresses are written as "about:blank", white space in them as %20; equal
payloads with equal ids are all responses; an empty file has no records and no
gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectable.llm.arrow import slices
from vectable.llm.registry import written
from vectable.session import broadcast_checked

LEAST = 1000  # fixed value: payload bytes from which equal payloads are written once
FILE_BYTES = 32 * 1024 * 1024
REPEAT_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"  # nothing reads the clock; an argument of the writer
END = b"\r\n\r\n"
RECORDS = (
    "file string, start bigint, record_id string, record_type string, uri string, payload binary, "
    "payload_bytes bigint, payload_digest string, refers_to string, gap_bytes bigint, reason string"
)


def with_digests(pages: DataFrame, page_id: str, payload: str) -> DataFrame:
    """``pages`` with payload, digest and refers_to: repeats of a payload of ``LEAST`` bytes refer to its largest id.

    The largest id per payload is a map-side aggregation over digests; it is
    joined back to ids and digests only. The repeats found are brought to the
    payloads by id, broadcast while they are few (counted), so that payloads
    are shuffled only when there are many.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    known = pages.drop("digest", "refers_to").withColumn("payload", body).withColumn("digest", F.sha1(body.cast("binary")))
    narrow = known.select(page_id, "digest", F.octet_length("payload").alias("size")).filter(F.col("size") >= LEAST)
    chosen = narrow.groupBy("digest", "size").agg(F.max(page_id).alias("chosen"), F.count("*").alias("copies"))
    repeats = narrow.join(chosen.filter("copies > 1"), ["digest", "size"]).filter(F.col("chosen") != F.col(page_id))
    repeats = written(repeats.select(page_id, "digest", F.col("chosen").alias("refers_to")).distinct(), "repeats")
    return known.join(broadcast_checked(repeats, REPEAT_ROWS), [page_id, "digest"], "left")


def record_text(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """The record without its last CR LF, which the sink adds."""
    name = F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))
    repeat = refers_to.isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(repeat, F.lit("")).otherwise(payload))
    uri = F.regexp_replace(F.coalesce(F.nullif(F.trim(url), F.lit("")), F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    more = F.when(
        repeat,
        F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
            F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">\r\n"),
        ),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(repeat, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\n"), more, F.lit("WARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    )


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
    date: str = DATE, compression: str = "none",
) -> None:
    """Archives of ``pages`` below ``path``; ``compression`` is the text sink's (gzip: one member per file)."""
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.col(payload).alias("html"))
    rows = with_digests(rows, "page", "html")
    text = record_text(*(F.col(c) for c in ("page", "url", "payload", "digest", "refers_to")), date)
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(payload), F.lit(0)))).first()[0] or 0
    sink = rows.select(text.alias("value")).write.option("lineSep", "\r\n").option("compression", compression)
    sink.option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 600)))).text(path)


def read_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Records and gaps of all archives below ``path`` (see ``RECORDS``); gaps have a ``reason`` and no record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(_records, RECORDS)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in RECORDS.split(", ")])
    for batch in batches:
        for row in (r for part in slices(batch, 1) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)):
            found, held = [], 0
            for record in salvage(row[1]):
                found.append({"file": row[0], **record})
                held += len(record.get("payload") or b"") + 500
                if held > 1 << 21:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in found], schema)
                    found, held = [], 0
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in found], schema)


class Damage(ValueError):
    """A check of a record failed."""


_HEAD = re.compile(rb"WARC/\d\.\d+\r?\n")
_HEAD_END = re.compile(rb"\r\n\r\n|WARC/\d\.\d+\r?\n")  # a header of any length, up to the next version line
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d+\r?\n")


def salvage(content: bytes) -> Iterator[dict]:
    """Records of one archive in order, and a gap for each run of bytes that passes no check."""
    at, bad, why = 0, None, ""
    while at < len(content):
        try:
            if content[at : at + 3] == b"\x1f\x8b\x08":
                found, end = _member(content, at)
            else:
                record, end = _record(content, at)
                found = [record]
        except Damage as error:
            if bad is None:
                bad, why = at, str(error)
            nxt = _START.search(content, at + 1)
            at = nxt.start() if nxt else len(content)
            continue
        if bad is not None:
            yield {"start": bad, "gap_bytes": at - bad, "reason": why}
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield {"start": bad, "gap_bytes": len(content) - bad, "reason": why}


def _member(content: bytes, at: int) -> tuple[list[dict], int]:
    """Records of the gzip member at ``at`` and where it ends; all start where the member does."""
    inflate, data, end = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and end < len(content):
            data.append(inflate.decompress(content[end : end + 65536]))
            end = min(end + 65536, len(content))
    except zlib.error as error:
        raise Damage(f"gzip: {error}") from None
    if not inflate.eof:
        raise Damage("gzip: the member is cut")
    found = list(salvage(b"".join(data)))
    for record in found:
        record["start"] = at
    return found, end - len(inflate.unused_data)


def _record(content: bytes, at: int) -> tuple[dict, int]:
    head = _HEAD.match(content, at)
    if not head:
        raise Damage("no version line")
    found = _HEAD_END.search(content, head.end() - 2)
    if not found or found[0] != END:
        raise Damage("the header block has no end")
    stop = found.start()
    fields = {}
    for line in content[head.end() : stop].decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if line and not colon:
            raise Damage("a header line has no colon")
        fields.setdefault(key.strip().lower(), value.strip())
    if not fields.get("content-length", "").isdecimal():
        raise Damage("no content length")
    begin = stop + len(END)
    end = begin + int(fields["content-length"])
    if content[end : end + 4] != END:
        raise Damage("no end mark where the length points")
    block, kind = content[begin:end], fields.get("warc-type")
    size, payload = None, block
    if "application/http" in fields.get("content-type", ""):
        http, _, payload = block.partition(END)
        said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        size = int(said[1]) if said else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
    if kind == "revisit":
        payload = None
    else:
        real = hashlib.sha1(payload).hexdigest()
        if digest not in (None, real):
            raise Damage("the payload differs from its digest")
        digest, size = real, len(payload)
    record = {
        "start": at, "record_id": fields.get("warc-record-id"), "record_type": kind, "uri": fields.get("warc-target-uri"),
        "payload": payload, "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("warc-refers-to"),
    }
    return record, end + len(END)
