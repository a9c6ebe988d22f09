"""WARC archives: a data source that writes and reads them, and page archives with revisit records.

Files are gzipped record by record. Each member's extra field ``sl`` holds the member's length, so a
reader that does not want a record jumps over it; members without the field are inflated to find
their end. A file is one partition of the scan; the writer begins a new one after ``FILE_BYTES``. Filters on record type and on headers are pushed into the scan: headers are parsed first,
and a record that fails a filter is neither inflated further nor decoded.

Files are opened through Arrow's file systems, so a path can be local to a shared mount or in an
object store. A task writes files of its own name; only those of successful tasks are entered in the
commit list, and readers take the listed files, so a task that ran twice leaves nothing twice.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.llm.text import narrow
from pulsegrid.session import settle, shared_path

READ = ("record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
        "payload_bytes long, content_length long, headers map<string,string>, payload binary, file string, offset long")
WRITE = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
# Column of a filter that is pushed: the header that holds it.
PUSHED = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
COMMITS = "_commits"
DATE = "2024-01-01T00:00:00Z"
# The payload's length, also on revisit records, which carry no payload.
LENGTH_HEADER = "X-Payload-Length"
FILE_BYTES = 64 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


# ---- records ----

def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field gives its own length and that of the data."""
    packed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def _clean(value: str) -> str:
    """A header value on one line: controls, the percent sign and blanks at either end are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]|^ +| +\Z", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), value)


def _plain(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 128 else m[0], value)


def record(row: dict) -> bytes:
    """The WARC record of a row of ``WRITE``; a response carries an HTTP head and the payload."""
    payload = row["payload"] if row["payload"] is not None else b""
    block = b""
    if row["record_type"] == "response":
        block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)) + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE)]
    for name, key in (("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to")):
        if row[key] is not None:
            head.append((name, _clean(row[key])))
    if row["record_type"] == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), (LENGTH_HEADER, str(row["payload_bytes"])),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in head], "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_headers(data: bytes | bytearray) -> tuple[dict[str, str], int]:
    """Headers by lower-case name, and where the block begins."""
    end = data.index(b"\r\n\r\n") + 4
    lines = data[:end - 4].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip(" \t").lower(): value.strip(" \t") for name, _, value in pairs}, end


def http_payload(block: bytes) -> bytes:
    head = block.find(b"\r\n\r\n")
    return block[head + 4:] if block.startswith(b"HTTP/") and head >= 0 else block


# ---- reading ----

@dataclass
class WarcPart(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """One partition a file; ``payload=false`` leaves every payload undecoded, ``verify=true`` checks digests."""

    HEAD = 1 << 16

    def __init__(self, options: dict, schema: pa.Schema):
        self.path, self.schema = options["path"], schema
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            column = getattr(one, "attribute", ("",))
            if len(column) == 1 and column[0] in PUSHED and isinstance(one, (EqualTo, In)):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                values = {f"sha1:{v}" if column[0] == "payload_digest" else _clean(v) for v in values if v is not None}
                header = PUSHED[column[0]]
                self.wanted[header] = self.wanted.get(header, values) & values
            elif not (isinstance(one, IsNotNull) and column[0] == "record_type"):
                yield one

    def partitions(self) -> list[WarcPart]:
        return [WarcPart(p) for p in committed(self.path)]

    def read(self, partition: WarcPart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        rows, size = [], 0
        place, path = open_place(partition.path)
        with place.open_input_file(path) as file:
            for offset, head, block in self._records(file):
                rows.append(self._row(head, block, partition.path, offset))
                size += len(block or b"")
                if len(rows) >= 1000 or size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, self.schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.schema)

    def _records(self, file) -> Iterator[tuple[int, dict, bytes | None]]:
        """(offset, headers, block) of wanted records; the block is None where payloads are not asked for."""
        offset, total = 0, file.size()
        while offset < total:
            first = file.read_at(min(self.HEAD, total - offset), offset)
            if first[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at {offset}")
            length = _member_length(first)
            inflate, at = zlib.decompressobj(31), offset + len(first)
            data, sought = bytearray(inflate.decompress(first, 4096)), 0
            while data.find(b"\r\n\r\n", sought) < 0:
                # Headers of any length: on through what was read, then through the file.
                sought, chunk = max(0, len(data) - 3), inflate.unconsumed_tail
                if not chunk and not inflate.eof:
                    chunk = file.read_at(min(self.HEAD, total - at), at)
                    at += len(chunk)
                if not chunk:
                    raise ValueError(f"headers at {offset} do not end within their member")
                data += inflate.decompress(chunk, 1 << 20)
            head, begin = parse_headers(data)
            wanted = all(head.get(name) in values for name, values in self.wanted.items())
            if length is None or wanted and self.payload:
                while not inflate.eof:
                    chunk = inflate.unconsumed_tail
                    if not chunk:
                        chunk = file.read_at(min(1 << 20, total - at), at)
                        at += len(chunk)
                    if not chunk:
                        raise ValueError(f"the member at {offset} ends early")
                    data += inflate.decompress(chunk)
                length = at - offset - len(inflate.unused_data)
            if wanted:
                block = bytes(data[begin:begin + int(head.get("content-length", 0))]) if self.payload else None
                yield offset, head, block
            offset += length

    def _row(self, head: dict, block: bytes | None, path: str, offset: int) -> dict:
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        payload = None
        length = int(head[LENGTH_HEADER.lower()]) if LENGTH_HEADER.lower() in head else None
        if block is not None and head.get("warc-type") == "response":
            payload = http_payload(block)
            if self.verify and (base32_sha1(payload) != digest or length not in (None, len(payload))):
                raise ValueError(f"{path}: the payload at {offset} does not match its headers")
            length = len(payload)
        decoded = {k: _plain(head[k]) if k in head else None for k in ("warc-target-uri", "warc-refers-to")}
        return {
            "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "date": head.get("warc-date"),
            "target_uri": decoded["warc-target-uri"], "refers_to": decoded["warc-refers-to"], "payload_digest": digest,
            "payload_bytes": length, "content_length": int(head.get("content-length", 0)), "headers": list(head.items()),
            "payload": payload, "file": path, "offset": offset,
        }


def _member_length(first: bytes) -> int | None:
    """The member's length from its extra field ``sl``, None without one."""
    if not first[3] & 4:
        return None
    size, = struct.unpack_from("<H", first, 10)
    at = 12
    while at + 4 <= 12 + size:
        name, n = first[at:at + 2], struct.unpack_from("<H", first, at + 2)[0]
        if name == b"sl" and n == 8:
            return struct.unpack_from("<I", first, at + 4)[0]
        at += 4 + n
    return None


def committed(path: str) -> list[str]:
    """The files of an archive folder: those of its commit lists, or all .warc.gz files of a folder without any."""
    place, root = open_place(path)
    lists = place.get_file_info(pyarrow.fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    prefix = path.rstrip("/")
    if lists:
        return sorted(f"{prefix}/{name}" for one in lists for name in json.loads(place.open_input_file(one.path).read()))
    info = place.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    files = place.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    return sorted(f"{prefix}{f.path[len(root):]}" for f in files if f.path.endswith(".warc.gz"))


# ---- writing ----

@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Records of ``WRITE`` rows in gzipped files of about ``FILE_BYTES``."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, root = open_place(self.path)
        place.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = place.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        place, root = open_place(self.path)
        place.create_dir(f"{root}/{COMMITS}", recursive=True)
        names = [name for m in messages if m is not None for name in m.names]
        with place.open_output_stream(f"{root}/{COMMITS}/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        place, root = open_place(self.path)
        for m in messages:
            for name in m.names if m is not None else []:
                place.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of an archive folder or file."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Adds the records (columns of ``WRITE``) to an archive folder."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select(*[c.split()[0] for c in WRITE.split(", ")]).write.format("warc").mode("append").save(path)


# ---- page archives ----

URN = "urn:page:"


def _urn(page_id) -> Column:
    return F.when(page_id.isNotNull(), F.concat(F.lit(f"<{URN}"), page_id.cast("string"), F.lit(">"))).otherwise(F.lit(f"<{URN}>"))


def page_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """One record per page: of equal payloads of at least ``least_bytes`` the page with the largest id is the
    response and the others revisit it; shorter ones are all responses.

    The payload is the html in UTF-8, null is empty. A null page id ranks below all; rows that repeat the
    largest id are all responses. Only digests are grouped, with partial sums; pages are joined to the
    groups of two or more, a table that Spark sends round while it is small and else joins by digest
    and id, splitting hot ones.
    """
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col).select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(
        F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("sha", "leader")
    groups = settle(groups, "payload-groups")
    joined = rows.join(groups, "sha", "left")
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"), F.when(revisit, _urn(F.col("leader"))).alias("refers_to"),
        F.hex("sha").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0, **columns) -> str:
    """Writes the pages' records into an archive folder (a new one in the shared folder by default); its path."""
    path = path or shared_path(pages.sparkSession, "warc")
    records = page_records(pages, least_bytes, **columns)
    write_warc(records.withColumn("payload_digest", base32(F.col("payload_digest"))), path)
    return path


def base32(hexed: Column) -> Column:
    """Base32 of 20 bytes given as hex: 5 bits for each letter, in groups of 40 bits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def group(i: int) -> list:
        number = F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 10).cast("long")
        return [F.substring(letters, (F.shiftright(number, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
                for j in range(8)]

    return F.concat(*[letter for i in range(4) for letter in group(i)])


def page_id(urn: Column, kind: str = "long") -> Column:
    """The page id of a record id; null for the id of a page without one."""
    text = F.regexp_extract(urn, f"^<{URN}(.*)>$", 1)
    return F.when(text != "", text.cast(kind))
