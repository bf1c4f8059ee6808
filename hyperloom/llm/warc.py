"""Legacy ARC archives converted to WARC.

An ARC file starts with a version block whose second line gives the version and the next line the field names of the record header lines (5
fields in version 1, 10 in version 2). Each record is a header line, the declared number of bytes, and a line end.
The converter reads records by these declared lengths and writes WARC/1.0 records with synthesised ids, timestamps, types and digests. A record
whose payload another record already carries in full becomes a revisit with the response's id.

Archives are values of a binary column: segments of some megabytes, each a valid sequence of gzip members. Null html counts as empty. Of equal payloads, the rows
with the largest page id are responses, all of them where that id repeats, whatever their urls; the others are revisits of that id (of its smallest url). Rows
without a page id never outrank others; among themselves they are all responses. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.storage import materialize

LEAST_REVISIT = 1000
SEGMENT_BYTES = 4 << 20
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
#: Header fields of the two ARC versions (fixed by the format).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


def capture_time(page_id: int) -> str:
    """The 14 digits of a synthetic fetch time: a minute for each page id since 2000."""
    return (EPOCH + timedelta(minutes=page_id % 10_000_000)).strftime("%Y%m%d%H%M%S")


def clean_url(url: str | None) -> str:
    """A url as one field of a header line; '-' for none."""
    return re.sub(r"\s+", "%20", url or "") or "-"


# --- ARC -------------------------------------------------------------------------------------------------------------


def arc_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} {'0' if version == 1 else '1'} hyperloom\n{' '.join(FIELDS[version])}\n".encode()
    first = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body))}
    rest = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}
    return " ".join((first | rest)[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, url: str, date: str, block: bytes) -> bytes:
    values = {
        "URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Archive-length": str(len(block)),
        "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name,
    }
    return " ".join(values[f].replace(" ", "%20") or "-" for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record after the version block."""
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").split(" ")
        try:
            length = int(line[-1])
        except ValueError:
            raise ValueError(f"ARC header line without a length at byte {at}") from None
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"ARC record at byte {at} is cut off")
        at = end + 1 + length
        at += data[at : at + 1] == b"\n"
        if fields is None:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            fields = FIELDS[version]
            continue
        if len(line) != len(fields):
            raise ValueError(f"ARC header line with {len(line)} fields, not {len(fields)}")
        yield dict(zip(fields, line, strict=True)), block


# --- WARC ------------------------------------------------------------------------------------------------------------


def record_id(url: str, date: str, digest: str, page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {date} {digest}')}>"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    while data:
        reader = zlib.decompressobj(31)
        yield reader.decompress(data) + reader.flush()
        data = reader.unused_data


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for raw in members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def http_block(html: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html


def convert(fields: dict[str, str], block: bytes, page_id: int | None, digest: str, refers_to: int | None, target: str | None) -> bytes:
    """A WARC record for an ARC record: response, or revisit (HTTP header only) where ``refers_to`` is given."""
    head, _, _ = block.partition(b"\r\n\r\n")
    name = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(fields["URL"], fields["Archive-date"], digest, page_id),
        "WARC-Target-URI": fields["URL"], "WARC-Date": warc_date(fields["Archive-date"]), "WARC-IP-Address": fields["IP-address"],
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": name, "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": target or "", "X-Refers-To-Page": str(refers_to)}
        block = head + b"\r\n\r\n"
    return warc_record(headers | {"WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()}, block)


# --- tables ----------------------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds digest, keeper (page id of the response with this payload, where the payload is long enough) and its url.

    Grouping is by digest of long payloads only, with partial aggregation; the join back is split by adaptive execution if
    one payload is hot. Short ones bypass both.
    """
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = F.octet_length("html") >= least
    # A light first pass: only payloads that occur more than once have anything to say.
    keepers = (
        hashed.where(long).groupBy("digest")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("keeper"), F.min_by("url", F.struct(F.col("page_id").isNull(), -F.col("page_id"), "url")).alias("keeper_url"))
        .where("copies > 1").select(F.col("digest").alias("d"), "keeper", "keeper_url")
    )
    return hashed.join(keepers, long & (F.col("digest") == F.col("d")), "left").drop("d")


def arc_archives(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Pages (page_id, url, html, digest, keeper, keeper_url) as ARC segments, with what is known of each record beside the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[bytes], notes: list[dict], version: int) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.arc"
            kind = pa.list_(pa.struct([("page_id", pa.int64()), ("digest", pa.string()), ("keeper", pa.int64()), ("keeper_url", pa.string())]))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_header(version, name, capture_time(0)) + b"".join(parts)], pa.binary()), pa.array([notes], kind)], names=["archive", "data", "notes"])

        parts, notes, size, version = [], [], 0, 1
        for batch in batches:
            for row in batch.to_pylist():
                record = arc_record(version, "-", clean_url(row["url"]), capture_time(row["page_id"] or 0), http_block(row["html"].encode()))
                parts.append(record)
                notes.append({k: row[k] for k in ("page_id", "digest", "keeper", "keeper_url")})
                size += len(record)
                if size >= segment_bytes:
                    yield close(parts, notes, version)
                    parts, notes, size, version = [], [], 0, 3 - version
        if parts:
            yield close(parts, notes, version)

    return pages.select("page_id", "url", "html", "digest", "keeper", "keeper_url").mapInArrow(
        run, "archive string, data binary, notes array<struct<page_id:long,digest:string,keeper:long,keeper_url:string>>"
    )


def convert_archives(arcs: DataFrame) -> DataFrame:
    """(archive, data) WARC segments from ARC segments (archive, data, notes), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for (fields, block), note in zip(read_arc(row["data"]), row["notes"], strict=True):
                    digest = hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest()
                    keeper = note["keeper"]
                    response = keeper is None or keeper == note["page_id"]
                    target = None if response else record_id(clean_url(note["keeper_url"]), capture_time(keeper), digest, keeper)
                    out.append(convert(fields, block, note["page_id"], digest, None if response else keeper, target))
                yield pa.RecordBatch.from_arrays([pa.array([row["archive"].removesuffix(".arc") + ".warc.gz"]), pa.array([b"".join(out)], pa.binary())], names=["archive", "data"])

    return materialize(arcs.mapInArrow(run, "archive string, data binary"), "warc")


def read_archives(warcs: DataFrame) -> DataFrame:
    """The records of WARC segments as op6 reports them; a revisit's payload length and digest are those of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                rows = []
                for headers, block in read_warc(data):
                    http = dict(x.split(": ", 1) for x in block.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                    payload = block.partition(b"\r\n\r\n")[2]
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
                    rows.append({
                        "page_id": int(headers["X-Page-Id"]) if headers["X-Page-Id"] else None, "payload_bytes": int(http["Content-Length"]) if revisit else len(payload), "payload_digest": digest,
                        "record_type": headers["WARC-Type"], "refers_to": int(headers["X-Refers-To-Page"]) if revisit else None, "url": headers["WARC-Target-URI"], "warc_date": headers["WARC-Date"], "record_id": headers["WARC-Record-ID"],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()), ("record_id", pa.string())]))

    return warcs.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string")
