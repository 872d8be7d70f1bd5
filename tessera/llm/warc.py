"""Legacy archive conversion: ARC records to WARC records, with duplicates as revisits.

ARC files of both versions are parsed by the field line that their version block declares and by the
declared length of each record; nothing is found by searching for separators. Each record becomes a
WARC/1.1 record: a record id made from its place, its date as a timestamp, a type by its content
(an HTTP response or a resource) and SHA-1 digests of block and payload. Archives are written by
Spark's text writer, one record a row, so that any store that Spark writes to holds them, and read
back as whole files by declared lengths.

Defined results: null html is an empty payload; empty payloads are duplicates like any others;
of equal payloads the record of the smallest page_id is the response (all rows of that id, if it is
repeated); a row without page_id refers to it, or is a response if no row has an id; a null url
becomes a urn; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch_path, tune_arrow

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    offset: int
    version: int

    @property
    def url(self) -> str:
        return self.fields["URL"]


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    http: bytes = b""  # head of an HTTP message, with its empty line
    payload: bytes = field(default=b"")


def plain_url(url: str | None, otherwise: str) -> str:
    """A URL without white space or control characters, as ARC headers need."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else otherwise


# ARC


def arc_version_block(version: int, name: str = "pages.arc", date: str = "20240101000000", org: str = "tessera") -> bytes:
    body = f"{version} 0 {org}\n{FIELDS[version]}\n\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    head += f"{len(body)}\n" if version == 1 else f"200 - - 0 {name} {len(body)}\n"
    return head.encode() + body


def arc_record(version: int, url: str, block: bytes, mime: str = "text/html", date: str = "20240101000000", ip: str = "0.0.0.0", name: str = "pages.arc", offset: int = 0) -> bytes:
    head = f"{url} {ip} {date} {mime} "
    head += f"{len(block)}\n" if version == 1 else f"200 {hashlib.sha1(block).hexdigest()} - {offset} {name} {len(block)}\n"
    return head.encode() + block


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of a whole ARC file (plain, or gzip of any number of members), without its version block."""
    if data[:2] == b"\x1f\x8b":
        data = gunzip(data)
    names, version, at = FIELDS[1].split(), 1, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # records are set apart by line breaks
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"the record at {at} declares {length} bytes; {len(block)} are left")
        if parts[0].startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            names = lines[1].split() if len(lines) > 1 and lines[1].strip() else FIELDS[version].split()
        else:
            if len(parts) > len(names):  # a content type may hold spaces
                extra = len(parts) - len(names)
                kind = names.index("Content-type")
                parts[kind : kind + extra + 1] = [" ".join(parts[kind : kind + extra + 1])]
            yield ArcRecord(dict(zip(names, parts, strict=False)), block, at, version)
        at = end + 1 + length


def warc_date(date: str) -> str:
    """``YYYYMMDDhhmmss``, or a leading part of it, as a timestamp."""
    date = re.sub(r"\D", "", date)[:14]
    date += "00000101000000"[len(date) :] if len(date) >= 4 else "19700101000000"[len(date) :]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_uuid(record: ArcRecord) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.url} {record.fields.get('Archive-date')} {record.offset}')}>"


def convert(record: ArcRecord, identify: Callable[[ArcRecord], str] = record_uuid) -> WarcRecord:
    """The equivalent WARC record."""
    http, payload = b"", record.block
    headers = {"WARC-Record-ID": identify(record), "WARC-Date": warc_date(record.fields.get("Archive-date", "")), "WARC-Target-URI": record.url}
    if (ip := record.fields.get("IP-address", "0.0.0.0")) not in ("0.0.0.0", "-"):
        headers["WARC-IP-Address"] = ip
    if record.block.startswith(b"HTTP/"):
        cut = record.block.find(b"\r\n\r\n")
        http, payload = (record.block[: cut + 4], record.block[cut + 4 :]) if cut >= 0 else (record.block, b"")
        headers |= {"WARC-Type": "response", "Content-Type": "application/http;msgtype=response"}
    else:
        headers |= {"WARC-Type": "resource", "Content-Type": record.fields.get("Content-type", "application/octet-stream")}
    headers["WARC-Payload-Digest"] = f"sha1:{sha1_base32(payload)}"
    headers["WARC-Block-Digest"] = f"sha1:{sha1_base32(record.block)}"
    return WarcRecord(headers, record.block, http, payload)


def as_revisit(record: WarcRecord, of: str) -> WarcRecord:
    """The record without its payload, referring to the one that has it."""
    headers = record.headers | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": of, "WARC-Block-Digest": f"sha1:{sha1_base32(record.http)}"}
    return WarcRecord(headers, record.http, record.http, b"")


# WARC


def warc_bytes(record: WarcRecord) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (record.headers | {"Content-Length": str(len(record.block))}).items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + record.block + b"\r\n\r\n"


def gunzip(data: bytes) -> bytes:
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of a whole WARC file (plain or gzip)."""
    if data[:2] == b"\x1f\x8b":
        data = gunzip(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        length = int(headers["Content-Length"])
        block = data[start : start + length]
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it declares")
        http, payload = b"", block
        if headers.get("Content-Type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n") + 4
            http, payload = block[:cut], block[cut:]
        yield WarcRecord(headers, block, http, payload)
        at = start + length + 4


# tables


def page_id_of(record: ArcRecord) -> str:
    """Record id from the page id that the response's head carries."""
    return f"<urn:x-page:{re.search(rb'X-Page-Id: ([^\r]*)', record.block[:400])[1].decode()}>"


def _first_pages(pages: DataFrame, least: int) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    return keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("digest", "first")


def write_archives(pages: DataFrame, path: str, least: int = 0, codec: str = "gzip", most: int = 20_000) -> None:
    """Pages as ARC records of both versions, converted, to WARC files of up to ``most`` records."""
    tune_arrow(pages.sparkSession)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.when(F.octet_length(payload) >= least, F.sha1(payload.cast("binary"))).alias("digest"))
    rows = rows.join(_first_pages(pages, least), "digest", "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, first = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            out: list[bytes] = []
            held, weight = [], 0
            for i in range(b.num_rows):
                body = b.column(2)[i].as_py().encode()
                held.append((ids[i], urls[i], first[i], body))
                weight += len(body)
                if weight > 4 << 20 or i == b.num_rows - 1:
                    out += _converted(held)
                    held, weight = [], 0
            # the writer adds the last byte of a record's end, a line break
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], names=["value"])

    made = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("compression", codec).option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)


def _converted(rows: list[tuple]) -> Iterator[bytes]:
    """One ARC file of each version, converted."""
    for version in FIELDS:
        mine = [r for r in rows if (r[0] or 0) % 2 == version - 1]
        if not mine:
            continue
        parts = [arc_version_block(version)]
        for page_id, url, _, body in mine:
            head = f"HTTP/1.1 200 OK\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
            parts += [arc_record(version, plain_url(url, f"urn:x-page:{page_id}"), head.encode() + body), b"\n"]
        for (page_id, _, first, _), record in zip(mine, parse_arc(b"".join(parts)), strict=True):
            made = convert(record, page_id_of)
            yield warc_bytes(made if first is None or first == page_id else as_revisit(made, f"<urn:x-page:{first}>"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each record."""
    tune_arrow(spark)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def page(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for r in parse_warc(content.as_py()):
                    digest = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r.headers["WARC-Type"] == "revisit":
                        size = int(re.search(rb"Content-Length: (\d+)", r.http)[1])
                    else:
                        size = len(r.payload)
                        if digest != sha1_base32(r.payload):
                            raise ValueError(f"{r.headers['WARC-Record-ID']}: the payload's digest differs")
                    rows.append({"page_id": page(r.headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": r.headers["WARC-Type"], "refers_to": page(r.headers.get("WARC-Refers-To")), "url": r.headers["WARC-Target-URI"]})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder; what is read back from them."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
