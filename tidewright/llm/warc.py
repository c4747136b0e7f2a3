"""Legacy ARC archives converted to WARC.

`write_arc` writes pages as ARC files (both versions), `parse_arc` reads records by their version's
header line and declared length, `convert` makes the equivalent WARC records
(identifiers, timestamps, types, digests; equal payloads become revisits) and `read_warc` reads WARC files
back by their declared lengths.

Scale: files are written by Spark's text writer (record separator = the format's own), in rows of about
CHUNK_BYTES and FILE_ROWS rows a file, so a file fits a task when it is read whole. Only
payload digests are shuffled to find equal payloads; the longest group of equal payloads is a
sum, not a list. Files are gzip-compressed as a whole, so they are read from the start and not by record.

Defined results: null html is an empty payload; a null url is archived as about:blank; null ids are
kept; rows equal in all columns are records of their own, of which one is the response;
an empty table gives an empty archive and result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import remove, shared_path, written

CHUNK_BYTES = 1 << 22
FILE_ROWS = 4
#: Payloads below this size are always stored.
REVISIT_BYTES = 1000
FIELDS = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
DATE = "20240101000000"


def http(page_id: int | None, body: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(body) + body


def arc_head(version: str, name: str) -> bytes:
    block = f"{version} 0 tidewright\n{FIELDS[version]}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", DATE, "text/plain"] + (["200", "-", "-", "0", name] if version == "2" else [])
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages as ARC archives of versions 1 and 2 by turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = count = 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, size, count
            whole, parts, size, count = b"\n".join(parts), [], 0, count + 1
            return pa.RecordBatch.from_arrays([pa.array([whole]).cast(pa.string())], ["value"])

        for batch in batches:
            for page_id, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = "12"[count % 2]
                if not parts:
                    parts.append(arc_head(version, f"pages-{page_id}.arc"))
                block = http(page_id, (body or "").encode())
                where = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
                fields = [where, "0.0.0.0", DATE, "text/html"]
                if version == "2":
                    fields += ["200", hashlib.md5(block).hexdigest(), "-", str(size), f"pages-{page_id}.arc"]
                parts.append(" ".join([*fields, str(len(block))]).encode() + b"\n" + block)
                size += len(block)
                if size >= CHUNK_BYTES:
                    yield flush()
        if parts:
            yield flush()

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("a"), F.col(f"`{url_col}`").alias("b"), F.col(f"`{html_col}`").alias("c"))
    rows.mapInArrow(run, "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)


def arc_records(data: bytes) -> Iterator[tuple[int, list[str], bytes]]:
    """(offset, header fields, block) of each record but the version blocks; blank lines between records are passed over."""
    at, names = 0, FIELDS["1"].split()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            break
        fields = data[at:stop].decode("utf-8", "replace").split(" ")
        length = int(fields[-1])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are left")
        if fields[0].startswith("filedesc://"):
            version = block.split(b" ", 1)[0].decode()
            if version not in FIELDS:
                raise ValueError(f"unknown archive version {version!r}")
            names = FIELDS[version].split()
        elif len(fields) != len(names):
            raise ValueError(f"record at {at} has {len(fields)} fields, its version has {len(names)}")
        else:
            yield at, fields, block
        at = stop + 1 + length


def opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def split_http(block: bytes) -> tuple[bytes, bytes, int | None]:
    """Head, body and page id of an HTTP message."""
    if not block.startswith(b"HTTP/"):
        return b"", block, None
    head, _, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
    return head, body, int(m[1]) if m else None


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def parse_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Records of ARC files: file and offset, page id, url, date, content type, payload's size and SHA-1, and the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                size = 0
                for offset, f, block in arc_records(opened(content.as_py())):
                    _, body, page_id = split_http(block)
                    rows.append((name.rsplit("/", 1)[-1], offset, page_id, f[0], f[2], f[3], f[1], len(body), hashlib.sha1(body).hexdigest(), block if blocks else None))
                    size += len(block)
                    if size >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["file", "offset", "page_id", "url", "date", "mime", "ip", "payload_bytes", "payload_digest", "block"]
    schema = "file string, offset long, page_id long, url string, date string, mime string, ip string, payload_bytes long, payload_digest string, block binary"
    return files(spark, path).mapInArrow(run, schema)


def iso(date: str) -> str:
    d = (date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, offset: int, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file} {offset} {url} {date}')}>"


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", sha1_32(block)), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def convert(spark: SparkSession, arc: str, path: str) -> None:
    """WARC files of all records of ARC files; of equal payloads the largest page id's is the response, the others revisit it."""
    index = written(spark, parse_arc(spark, arc, blocks=False).drop("block"), "arc-index")
    large = index.where(F.col("payload_bytes") >= REVISIT_BYTES)
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "file", "offset", "url", "date")).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(first, ["payload_digest", "payload_bytes"]).where("file <> to.file or `offset` <> to.`offset`").select(F.col("file").alias("_f"), F.col("offset").alias("_o"), "to")
    records = parse_arc(spark, arc)
    decided = records.join(again, (records["file"] == F.col("_f")) & (records["offset"] == F.col("_o")), "left").select("file", "offset", "url", "date", "mime", "ip", "block", *[F.col(f"to.{x}").alias(f"to_{x}") for x in ("file", "offset", "url", "date")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, size
            whole, parts, size = b"\r\n\r\n".join(parts), [], 0
            return pa.RecordBatch.from_arrays([pa.array([whole]).cast(pa.string())], ["value"])

        for batch in batches:
            for i in range(batch.num_rows):
                file, offset, url, date, mime, ip, block, to_file, to_offset, to_url, to_date = (c[i].as_py() for c in batch.columns)
                if not parts:
                    info = b"software: tidewright\r\nformat: WARC File Format 1.1\r\n"
                    parts.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Date", iso(date)), ("WARC-Record-ID", record_id(file, -1 - offset, url, date)), ("Content-Type", "application/warc-fields")], info))
                head, body, _ = split_http(block)
                is_http = bool(head)
                kind = "revisit" if to_file is not None else "response" if is_http or url.startswith("dns:") else "resource"
                fields = [("WARC-Type", kind), ("WARC-Target-URI", url), ("WARC-Date", iso(date)), ("WARC-Record-ID", record_id(file, offset, url, date)), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", sha1_32(body)), ("Content-Type", "application/http; msgtype=response" if is_http else mime)]
                if kind == "revisit":
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(to_file, to_offset, to_url, to_date)), ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", iso(to_date))]
                    block = head + b"\r\n\r\n"
                parts.append(warc_record(fields, block))
                size += len(block)
                if size >= CHUNK_BYTES:
                    yield flush()
        if parts:
            yield flush()

    decided.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        block = data[stop + 4 : stop + 4 + n]
        if len(block) < n or data[stop + 4 + n : stop + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end where it says")
        yield fields, block
        at = stop + 8 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files but the file descriptions; payload size and digest of what a record holds. Blocks and payloads must match their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for f, block in warc_records(opened(content.as_py())):
                    if sha1_32(block) != f["WARC-Block-Digest"]:
                        raise ValueError(f"digest of {f['WARC-Record-ID']} doesn't match")
                    if f["WARC-Type"] != "warcinfo":
                        _, body, page_id = split_http(block)
                        # What a revisit refers to isn't in its block; any other record's payload is, and must be what it says.
                        told = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
                        digest = told if f["WARC-Type"] == "revisit" else hashlib.sha1(body).hexdigest()
                        if digest != told:
                            raise ValueError(f"payload digest of {f['WARC-Record-ID']} doesn't match")
                        rows.append((f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Target-URI"), f.get("WARC-Date"), page_id, len(body), digest, f.get("WARC-Refers-To")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["record_id", "record_type", "url", "date", "page_id", "stored_bytes", "payload_digest", "refers_to_id"]
    return files(spark, path).mapInArrow(run, "record_id string, record_type string, url string, date string, page_id long, stored_bytes long, payload_digest string, refers_to_id string")


def archived(spark: SparkSession, pages: DataFrame, keep: str | None = None) -> DataFrame:
    """Pages to ARC, ARC to WARC (in `keep`, or in the shared folder), and the WARC records read back."""
    arc, path = shared_path(spark, "arc"), keep or shared_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, path)
    remove(spark, arc)
    records = written(spark, read_warc(spark, path), "records")
    if keep is None:
        remove(spark, path)
    first = records.select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"), F.col("stored_bytes").alias("_bytes"))
    revisits = records.where("refers_to_id is not null").join(first, F.col("refers_to_id") == F.col("_id")).select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "record_id")
    stored = records.where("refers_to_id is null").select("page_id", F.col("stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "record_id")
    return stored.unionByName(revisits)
