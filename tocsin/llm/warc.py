"""WARC archives as a Spark data source, and the records of crawled pages.

Reading plans one partition per archive file.  Every record is a gzip member
that carries its packed length in the ``sl`` extra field, so a record whose
header fails the pushed-down predicates, or whose payload nobody asks for, is
left packed: only its header is inflated, and the reader seeks to the next one.
Archives of other programs, packed or plain, are read from end to end.
"""

from __future__ import annotations

import base64
import binascii
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from tocsin.llm.shared import ship, stored

# Columns of a record; leave ``payload`` out of a read to leave payloads packed.
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)
# Payloads of fewer bytes are never made revisits.
LEAST = 1000
# Packed bytes after which a writer begins another file, and bytes of a header that are read at first.
FILE_BYTES, HEAD = 64 << 20, 4096
# Bytes that are taken in at one time, and of the longest header.
CHUNK, LONGEST_HEAD = 1 << 18, 1 << 20
# Numbers that mark digests which occur twice.
MARKS = 1 << 21
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_archives-"


def _line(value: str) -> str:
    """A header value on one line: control characters and % as in URLs."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _unline(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record(row: dict, date: str) -> bytes:
    """The bytes of one record; ``row`` has the columns of RECORD."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (row["payload"] or b"" if row["record_type"] == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:page:{row['page_id']}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if row["url"] is None else _line(row["url"]),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": row["payload_bytes"],
        "WARC-Refers-To": None if row["refers_to"] is None else f"<urn:page:{row['refers_to']}>",
        "WARC-Profile": PROFILE if row["record_type"] == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` has its packed and full length."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (names in lower case) and the header's length; None if it does not end in ``data``."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def _page(value: str | None) -> int | None:
    """The page of an id that names one; other ids name none."""
    number = (value or "").strip("<>")
    return int(number[9:]) if number.startswith("urn:page:") and number[9:].lstrip("-").isdigit() else None


def _digest(value: str | None) -> str | None:
    """A SHA-1 in base 32 or hexadecimal digits as hexadecimal digits; null for anything else."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() == "sha1" and len(text) == 32:
        try:
            return base64.b32decode(text.upper()).hex()
        except binascii.Error:
            return None
    return text.lower() if kind.lower() == "sha1" and len(text) == 40 else None


def values(head: dict[str, str]) -> dict:
    """What the header says about a record, by column; null where it says nothing."""
    url, size = head.get("warc-target-uri"), head.get("x-payload-length", "")
    # Only the records written here have their own escapes on top of a URL's.
    if url is not None:
        url = _unline(url) if size else url.strip("<>")
    return {
        "record_id": head.get("warc-record-id"),
        "date": head.get("warc-date"),
        "page_id": _page(head.get("warc-record-id")),
        "url": url,
        "record_type": head.get("warc-type"),
        "refers_to": _page(head.get("warc-refers-to")),
        "payload_bytes": int(size) if size.isdigit() else None,
        "payload_digest": _digest(head.get("warc-payload-digest")),
    }


class Inflated:
    """The bytes of an archive, plain or in gzip members one after the other, from the beginning on."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.left = stream, b"", 0, b""
        start = stream.read(2)
        stream.seek(0)
        self.inflate = zlib.decompressobj(31) if start == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Take in some more; False at the end.  Raises ``EOFError`` or ``zlib.error`` where the archive is damaged."""
        out = b""
        while not out:
            raw = self.left or self.stream.read(CHUNK)
            if not raw:
                if self.inflate and not self.inflate.eof and self.begun:
                    raise EOFError("an archive that ends inside a member")
                return False
            if self.inflate is None:
                out = raw
                continue
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out, self.begun = self.inflate.decompress(raw, CHUNK), True
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.begun = not self.inflate.eof
        self.data, self.at = self.data[self.at :] + out, 0
        return True

    begun = False

    def head(self) -> bytes | None:
        """Bytes up to the next empty line, blank ones before it left out; None at the end."""
        while True:
            while self.data[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            end = self.data.find(b"\r\n\r\n", self.at)
            if end >= 0:
                found, self.at = self.data[self.at : end + 4], end + 4
                return found
            if len(self.data) - self.at > LONGEST_HEAD:
                raise EOFError("a header without an end")
            if not self.more():
                if self.data[self.at :].strip():
                    raise EOFError("an archive that ends inside a header")
                return None

    def take(self, size: int, keep: bool) -> bytes | None:
        """The next bytes, or None where they are not to be kept; never more than a part of those is held."""
        parts = []
        while size > 0:
            here = self.data[self.at : self.at + size]
            self.at += len(here)
            size -= len(here)
            if keep:
                parts.append(here)
            if size > 0 and not self.more():
                raise EOFError("an archive that ends inside a record")
        return b"".join(parts) if keep else None


def foreign_records(stream, wanted, payload: bool):
    """Rows of any archive, read from its beginning: headers first, unwanted payloads inflated and dropped.

    Records of every type and id are rows.  The payload of a record with an HTTP
    message is what stands behind the message's header, of others the whole
    block.  Where an archive is damaged, one row of the type ``broken`` tells
    so, with the header's values if there was one, and ends it.
    """
    source, row = Inflated(stream), None
    try:
        while True:
            row = None
            if (text := source.head()) is None:
                return
            found = headers(text)
            row = values(found[0])
            size = int(found[0]["content-length"])
            keep = payload and wanted(row)
            block = source.take(size, keep)
            if keep:
                message = found[0].get("content-type", "").startswith("application/http")
                at = block.find(b"\r\n\r\n") if message else -4
                body = block[at + 4 :] if not message or at >= 0 else b""
                row["payload"] = None if row["record_type"] == "revisit" else body
                if row["payload_bytes"] is None and row["payload"] is not None:
                    row["payload_bytes"] = len(body)
            if wanted(row):
                yield row
    except (EOFError, zlib.error, ValueError, KeyError, IndexError, UnicodeDecodeError):
        broken = (row or values({})) | {"record_type": "broken"} | ({"payload": None} if payload else {})
        if wanted(broken):
            yield broken


def records(stream, wanted, payload: bool):
    """Rows of an open archive: headers first, payloads only of wanted records.

    Where members carry the ``sl`` field, as those of :func:`packed` do, unwanted
    payloads are sought over; other archives are read by :func:`foreign_records`.
    """
    start, at = stream.read(24), 0
    stream.seek(0)
    if start[3:4] != b"\x04" or start[10:14] != b"\x0c\x00sl":
        yield from foreign_records(stream, wanted, payload)
        return
    while len(start := stream.read(24)) >= 18:
        flags, extra, name, _, size, _ = struct.unpack("<3xB6xH2sHII", start[:24].ljust(24, b"\0"))
        if not (flags == 4 and extra == 12 and name == b"sl"):
            stream.seek(at)
            yield from foreign_records(_From(stream, at), wanted, payload)
            return
        body = stream.read(min(HEAD, size - 24))
        inflate = zlib.decompressobj(-15)
        data = inflate.decompress(body, HEAD)
        read = 24 + len(body)
        while (head := headers(data)) is None:
            more = inflate.unconsumed_tail or stream.read(min(HEAD, size - read))
            read += 0 if inflate.unconsumed_tail else len(more)
            if not more:
                raise ValueError("an archive member without a header")
            data += inflate.decompress(more, HEAD)
        row = values(head[0])
        if wanted(row):
            if payload:
                row["payload"] = None
            if payload and row["record_type"] == "response":
                data += inflate.decompress(inflate.unconsumed_tail + stream.read(size - read)) + inflate.flush()
                block = data[head[1] : head[1] + int(head[0]["content-length"])]
                row["payload"] = block[block.index(b"\r\n\r\n") + 4 :]
            yield row
        at += size
        stream.seek(at)


class _From:
    """A stream whose beginning is some place of another."""

    def __init__(self, stream, first: int):
        self.stream, self.first = stream, first
        stream.seek(first)

    def read(self, size: int) -> bytes:
        return self.stream.read(size)

    def seek(self, place: int) -> None:
        self.stream.seek(self.first + place)


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters):
        """Take equality and membership on header columns; leave the rest to Spark."""
        for f in filters:
            column = getattr(f, "attribute", (None,))
            if isinstance(f, EqualTo) and column[0] != "payload":
                self.tests.append((column[0], [f.value]))
            elif isinstance(f, In) and column[0] != "payload":
                self.tests.append((column[0], list(f.value)))
            elif isinstance(f, IsNotNull) and column[0] != "payload":
                self.tests.append((column[0], None))
            else:
                yield f

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root))
        done = [i.path for i in found if i.base_name.startswith(MANIFEST)]
        names: list[str] = []
        for path in done:
            with system.open_input_stream(path) as stream:
                names += json.loads(stream.read())
        if not done:
            names = [i.base_name for i in found if i.base_name.endswith((".warc.gz", ".warc"))]
        return [Archive(name) for name in sorted(names)]

    def read(self, partition):
        if partition is None:  # Spark asks once where there is no archive
            return
        system, root = fs.FileSystem.from_uri(self.path)
        names = [f.name for f in self.schema]
        arrow = pa.schema([(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.string())) for f in self.schema])

        def wanted(row):
            return all(row[c] in v if v is not None else row[c] is not None for c, v in self.tests)

        with system.open_input_file(f"{root}/{partition.path}") as stream:
            rows, size = [], 0
            for row in records(stream, wanted, "payload" in names):
                rows.append({n: row[n] for n in names})
                size += len(row.get("payload") or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class WarcWriter(DataSourceArrowWriter):
    """Files with names of their own; a manifest lists those of tasks that were committed."""

    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, batches):
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root)
        names, stream = [], None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if stream is None or stream.tell() > FILE_BYTES:
                        if stream:
                            stream.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        stream = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                    stream.write(packed(record(row, self.date)))
        if stream:
            stream.close()
        return Written(names)

    def commit(self, messages):
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as stream:
            stream.write(json.dumps([n for m in messages if m for n in m.paths]).encode())

    def abort(self, messages):
        system, root = fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.paths):
            system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``format("warc")``: options ``path`` and, for writing, ``date`` (WARC-Date of all records)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records below a folder, of archives written here or anywhere else; without ``payload`` all payloads stay packed.

    Besides the columns of RECORD, ``record_id`` and ``date`` as the records give
    them; ids of pages are null in records that name no page.  See ``foreign_records``
    for damaged archives.
    """
    _ready(spark)
    columns = f"record_id string, date string, {RECORD if payload else RECORD.rpartition(',')[0]}"
    return spark.read.format("warc").schema(columns).load(path)


def page_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The record of every page, with the columns of RECORD.

    Of pages whose payloads are equal and have ``least`` bytes or more, the one
    with the largest page_id is the response and the others revisit it, without
    a payload.  Rows that repeat that page_id are responses as well.  A null
    html is an empty payload; a null page_id is never the largest, and where no
    page of a group has an id, all are responses.  Other columns are dropped.
    Only digests are aggregated.  Pages whose digest no other has are told apart
    where they lie, by a broadcast of at most ``MARKS`` numbers, and are moved
    nowhere, but for a few; the others meet the digests that occur twice.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    keys = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    shared = keys.agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1").drop("n")
    # Written first, so that Spark can split the join of a payload that very many pages share.
    shared = stored(shared, "warc-shared")
    mark = F.pmod(F.xxhash64("payload_digest"), F.lit(MARKS)).alias("_mark")
    marks = F.broadcast(shared.select(mark).distinct())
    rows = rows.withColumn("_mark", F.when(F.col("payload_bytes") >= least, mark))
    alone = rows.join(marks, "_mark", "left_anti").drop("_mark").withColumn("response", F.lit(None).cast(shared.schema["response"].dataType))
    again = rows.join(marks, "_mark", "left_semi").drop("_mark")
    other = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    met = again.join(shared, ["payload_digest", "payload_bytes"], "left")
    return met.unionByName(alone).select(
        "page_id",
        "url",
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("response")).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        F.when(~other, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the records of pages into a folder that all executors share."""
    _ready(pages.sparkSession)
    page_records(pages).write.format("warc").option("date", date).mode("append").save(path)
