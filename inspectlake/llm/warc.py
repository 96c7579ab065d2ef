"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer makes one record per page, each a gzip member of its own.  Of equal payloads of at least 100 bytes the one
with the smallest page id is a response and the others are revisit records that refer to it.  Spark's text sink writes
the files, with an empty gzip member as line separator, so they are ordinary multi-member archives.

The reader checks each record: the member unpacks, the version line and headers parse, the block has its full length and
its digest.  Where a check fails, it searches for the next member (or, in unpacked archives, the next version line) that
passes, goes on there, and logs the bytes between as a quarantined gap.

Scale: only compressed records are shuffled, by digest; equal payloads are counted before the shuffle, and the join
side with one row per repeated payload is small, so Spark can split a payload that many pages share.  Files are bounded
by the number of records in each, so that a reading task holds one small file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inspectlake.llm.common import column, fresh_path, map_arrow, written

LEAST_REVISIT = 100
#: Bytes of payloads and urls that an archive file is meant to hold.
FILE_BYTES = 16_000_000
#: Bytes that are unpacked at a time.
CHUNK = 4096
#: The record types of the format.
KINDS = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.[^\r\n]{0,100}\r\n")
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENDS = re.compile(r"[\r\n]")

RECORDS = "file string, start long, stop long, fault string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def record(page_id, url: str | None, digest: str, size: int, payload: bytes | None, refers_to=None) -> bytes:
    """A WARC/1.1 record; without payload it is a revisit record."""
    block = payload or b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_ENDS.sub(lambda m: '%0D' if m[0] == chr(13) else '%0A', url)}")
    if payload is None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes for the same data."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _pack(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"page_id": batch["page_id"], "url": batch["url"], "digest": [], "size": [], "packed": []}
    for page, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist()):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        out["digest"].append(digest)
        out["size"].append(len(payload))
        out["packed"].append(member(record(page, url, digest, len(payload), payload)))
    return out


def _revisits(batch: pa.RecordBatch) -> dict:
    packed = [
        p if to is None else member(record(page, url, digest, size, None, to))
        for page, url, digest, size, to, p in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "digest", "size", "first", "packed")])
    ]
    return {"value": packed}


def write_archives(pages: DataFrame, path: str) -> int:
    """Archives of all ``pages`` (page_id, url, html) in the new folder ``path``; gives the number of pages.

    A null html is an empty payload and a null url is left out.  Rows that share the smallest page_id of a payload are
    all responses, as are rows without an id; an empty table gives no records.
    """
    own = pages.select(*[column(pages, c).alias(c) for c in ("page_id", "url", "html")])
    html = F.coalesce("html", F.lit("")).cast("binary")
    big = own.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= LEAST_REVISIT)
    first = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    packed = map_arrow(own, "page_id long, url string, digest string, size long, packed binary", _pack)
    joined = packed.join(first, "digest", "left").withColumn("first", F.when(F.col("page_id") != F.col("first"), F.col("first")))
    mean, n = own.agg(F.avg(F.octet_length(html) + F.coalesce(F.octet_length("url"), F.lit(0))), F.count("*")).first()
    mean = mean or 1.0
    lines = map_arrow(joined, "value binary", _revisits).select(F.col("value").cast("string"))
    (
        lines.write.option("lineSep", _EMPTY.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", max(1, int(FILE_BYTES / max(mean, 1.0))))
        .text(path)
    )
    return n


def _head(data: bytes, at: int) -> tuple[dict[str, str], int] | str:
    """Headers of the record at ``at`` and where its block begins, or what is wrong.

    Headers have no greatest length, as the writer's have none.  They are read line by line, so what is no header ends
    the search.
    """
    if not (version := _VERSION_LINE.match(data, at)):
        return "version" if not data.startswith(_VERSION, at) else "headers"
    at, fields = version.end(), {}
    while (stop := data.find(b"\r\n", at)) != at:
        name, mark, value = data[at : max(stop, at)].decode("utf-8", "replace").partition(":")
        if not mark or "\r" in name or "\r" in value:
            return "headers"
        fields[name.strip().lower()] = value.strip()
        at = stop + 2
    return (fields, at + 2) if fields.get("content-length", "").isdigit() else "length"


def read_record(data: bytes, at: int = 0) -> tuple[dict, int] | str:
    """The record that starts at ``at`` and where it ends, or what is wrong with it."""
    head = _head(data, at)
    if isinstance(head, str):
        return head
    fields, at = head
    stop = at + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "length"
    block = data[at:stop]
    if (said := fields.get("warc-block-digest", "")) and said.removeprefix("sha256:") != hashlib.sha256(block).hexdigest():
        return "digest"
    kind = fields.get("warc-type", "")
    if kind not in KINDS:
        return "type"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    if kind == "response" and digest and digest != hashlib.sha256(block).hexdigest():
        return "digest"
    return {
        "page_id": number("warc-record-id"),
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": len(block) if kind == "response" else int(fields.get("x-payload-length") or 0),
        "payload_digest": digest,
        "payload": block if kind == "response" else None,
    }, stop + 4


def _unpack(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The member at ``at`` and where it ends.  It is fed in pieces: what follows a member is copied when it ends."""
    unpacker, parts = zlib.decompressobj(31), []
    try:
        while at < len(data) and not unpacker.eof:
            parts.append(unpacker.decompress(data[at : at + CHUNK]))
            at += CHUNK
    except zlib.error:
        return "member"
    return (b"".join(parts), min(at, len(data)) - len(unpacker.unused_data)) if unpacker.eof else "member"


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order, with ``start`` and ``stop``; gaps have a ``fault`` instead of a record."""
    at, gap, fault = 0, None, ""
    ahead = dict.fromkeys((_MAGIC, _VERSION), -1)  # next place of each mark, searched again only once it is passed
    while at < len(data):
        packed = data.startswith(_MAGIC, at)
        got: tuple | str
        if packed:
            got = _unpack(data, at)
            if not isinstance(got, str):
                raw, stop = got
                if not raw:
                    got = ("", stop)
                else:
                    inner = read_record(raw)
                    got = inner if isinstance(inner, str) else "trailing" if inner[1] != len(raw) else (inner[0], stop)
        else:
            got = read_record(data, at)
        if isinstance(got, str):
            if gap is None:
                gap, fault = at, got
            for mark, place in ahead.items():
                if place <= at:
                    found = data.find(mark, at + 1)
                    ahead[mark] = found if found >= 0 else len(data)
            at = min(ahead.values())
            continue
        if gap is not None:
            yield {"start": gap, "stop": at, "fault": fault}
            gap = None
        if got[0]:
            yield got[0] | {"start": at, "stop": got[1]}
        at = got[1]
    if gap is not None:
        yield {"start": gap, "stop": len(data), "fault": fault}


def read_archives(spark, path: str) -> DataFrame:
    """Records and quarantined gaps (those with a ``fault``) of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in names}
        for file, content in zip(batch["path"].to_pylist(), batch["content"]):
            for row in salvage(content.as_py()):
                for n in names:
                    out[n].append(file if n == "file" else row.get(n))
        return out

    return map_arrow(files, RECORDS, work)


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    It fails where the records read back are not as many as the pages written.
    """
    path = fresh_path(pages.sparkSession, "warc")
    pages_written = write_archives(pages, path)
    back = read_archives(pages.sparkSession, path).select("fault", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    back = written(back, "records")
    records, gaps = back.agg(F.count(F.when(F.col("fault").isNull(), 1)), F.count("fault")).first()
    if gaps or records != pages_written:
        raise ValueError(f"{records} records and {gaps} gaps were read back from {pages_written} pages")
    return back.drop("fault")
