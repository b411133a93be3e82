"""A WARC data source for Spark: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing. Each task writes gzip'd WARC 1.1 files, one gzip member a record, and starts a new file
past ``maxFileBytes``. Members carry their length in the gzip header's ``sl`` extra field. A
job's commit writes ``_MANIFEST`` with the files of the tasks that succeeded, so what a lost
executor or a second attempt left behind is never read.

Reading. The driver plans one partition per file, from the manifest where there is one and else
from the folder or file named. Filters on the record type and on headers are pushed to the
reader. A member's header is inflated first; if a filter rejects it, or the payload column is
not asked for, the reader seeks to the next member and never inflates the payload. Members
without the ``sl`` field, and plain ``.warc`` files, are read through in order.

Paths are read with pyarrow's file systems (``file://``, ``hdfs://``, ``s3://``, ``gs://``), on the
executors as on the driver.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Columns and the headers they hold.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Identified-Payload-Length",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
MANIFEST = "_MANIFEST"
HTTP_TYPE = "application/http; msgtype=response"
#: The profile a revisit names when the payload is the same, as the format defines it.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20
PEEK = 1 << 14


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A record before compression; line breaks cannot occur in a header's value."""
    lines = ["WARC/1.1"]
    for k, v in headers.items():
        if v is not None:
            lines.append(f"{k}: {' '.join(str(v).split())}")
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that tells its own length, and the data's, in an ``sl`` extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    if length >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


#: A longer record header is taken for something else.
MOST_HEADER = 16 << 20


def parse_headers(data: bytes) -> dict[str, str]:
    """Names lower-cased; a folded line continues the one before; the first line is the version."""
    out: dict[str, str] = {}
    last = None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without its HTTP header where it is an HTTP message."""
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


class _Stream:
    """Bytes of a file from a position on: plain, or inflated member by member."""

    def __init__(self, file: pa.NativeFile, size: int, zipped: bool) -> None:
        self.file, self.size, self.zipped, self.at = file, size, zipped, 0
        self.packer, self.ready, self.fed = None, b"", 0
        self.member_at, self.member_length = 0, None

    def next_member(self) -> bool:
        """Move to the next gzip member and read its header."""
        if self.at >= self.size:
            return False
        self.member_at = self.at
        self.file.seek(self.at)
        head = self.file.read(PEEK)
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {self.at}")
        flags, pos, self.member_length = head[3], 10, None
        if flags & 4:
            extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]]
            pos += 2 + len(extra)
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.member_length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for bit in (8, 16):
            if flags & bit:
                pos = head.index(b"\0", pos) + 1
        pos += 2 if flags & 2 else 0
        self.packer, self.ready, self.fed = zlib.decompressobj(-15), b"", pos
        self.left = head[pos:]
        return True

    def inflate(self, most: int) -> bytes:
        """Up to ``most`` more bytes of the member; empty at its end."""
        while not self.packer.eof:
            if not self.left:
                self.file.seek(self.member_at + self.fed)
                self.left = self.file.read(1 << 20)
                if not self.left:
                    raise EOFError("a gzip member ends early")
            before = len(self.left)
            out = self.packer.decompress(self.left, most)
            self.left = self.packer.unconsumed_tail if not self.packer.eof else b""
            unused = len(self.packer.unused_data)
            self.fed += before - len(self.left) - unused
            if out:
                return out
        return b""

    def end_member(self) -> None:
        """Go behind the member: by its length if known, else by inflating what is left."""
        if self.member_length is None:
            while self.inflate(1 << 20):
                pass
            self.at = self.member_at + self.fed + 8
        else:
            self.at = self.member_at + self.member_length


def _begins(data: bytes, where: str) -> None:
    """Raise as soon as what is read is seen to be no record, before all of a strange file is in memory."""
    if not data.startswith(b"WARC/"[: len(data)]) or len(data) > MOST_HEADER:
        raise ValueError(f"no record header {where}")


def _head(data: bytes, at: int, where: str) -> tuple[dict[str, str], int]:
    """Headers of a record that ends its header at ``at``, and the length of its block."""
    if at < 0 or not data.startswith(b"WARC/"):
        raise ValueError(f"no whole record header {where}")
    headers = parse_headers(data[:at])
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError(f"a record without its length {where}")
    return headers, int(length)


def _of_member(stream: _Stream, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of a gzip member: one, in archives written here and most others, but there may be more."""
    data, where = b"", f"in the member at {stream.member_at}"
    while True:
        while (at := data.find(b"\r\n\r\n")) < 0 and (more := stream.inflate(4096)):
            data = data + more if data else more.lstrip(b"\r\n")
            _begins(data, where)
        if not data:
            return
        headers, length = _head(data, at, where)
        block, data = data[at + 4 : at + 4 + length], data[at + 4 + length :]
        take = wanted(headers)
        if not (take and with_payload) and stream.member_length is not None:  # nothing else lies in such a member
            if take:
                yield headers, None
            return
        parts, rest = [block], length - len(block)
        while rest > 0 and (more := stream.inflate(1 << 20)):
            if take and with_payload:
                parts.append(more[:rest])
            data, rest = more[rest:], rest - len(more)
        if rest > 0:
            raise EOFError(f"a record ends early {where}")
        if take:
            yield headers, payload_of(headers, b"".join(parts)) if with_payload else None
        data = data.lstrip(b"\r\n")


def read_records(file: pa.NativeFile, size: int, zipped: bool, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payloads of the records that ``wanted(headers)`` accepts.

    A member may hold several records. A file that is cut, within a header or a block, or holds something else raises; nothing
    is left out silently. Blocks of rejected records are skipped in plain files, and in members that tell their length (the ``sl`` field
    of archives written here); in other members they have to be inflated to be passed over.
    """
    if zipped:
        stream = _Stream(file, size, True)
        while stream.next_member():
            yield from _of_member(stream, wanted, with_payload)
            stream.end_member()
        return
    at = 0
    while at < size:
        data, pos = b"", at
        while (end := data.find(b"\r\n\r\n")) < 0 and pos < size:
            file.seek(pos)
            more = file.read(PEEK)
            pos += len(more)
            data = data + more if data else more.lstrip(b"\r\n")
            _begins(data, f"at {pos - len(data)}")
        at = pos - len(data)
        if not data:
            return
        headers, length = _head(data, end, f"at {at}")
        if at + end + 4 + length > size:
            raise EOFError(f"the record at {at} ends early")
        if wanted(headers):
            block = None
            if with_payload:
                file.seek(at + end + 4)
                block = payload_of(headers, file.read(length))
            yield headers, block
        at += end + 4 + length


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names
        self.tests: list[tuple[str, str, tuple]] = []
        unknown = [n for n in self.names if n not in HEADERS and n != "payload"]
        if unknown:
            raise ValueError(f"a WARC table has no columns {unknown}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if len(getattr(f, "attribute", ())) == 1 and name in HEADERS and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                kind = "present" if isinstance(f, IsNotNull) else "prefix" if isinstance(f, StringStartsWith) else "in"
                values = () if kind == "present" else tuple(f.value) if isinstance(f, In) else (f.value,)
                self.tests.append((HEADERS[name].lower(), kind, values))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [WarcFile(self.path)]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        base = self.path.rstrip("/")
        if system.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                return [WarcFile(f"{base}/{n}") for n in json.loads(f.read().decode())]
        names = [x.base_name for x in system.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.File]
        return [WarcFile(f"{base}/{n}") for n in sorted(names) if n.endswith((".warc", ".warc.gz"))]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, name = _open(partition.path)
        types = [pa.binary() if n == "payload" else pa.string() for n in self.names]
        rows, held = [], 0

        def wanted(headers: dict[str, str]) -> bool:
            for header, kind, values in self.tests:
                have = headers.get(header)
                if have is None or (kind == "prefix" and not have.startswith(values[0])) or (kind == "in" and have not in values):
                    return False
            return True

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=self.names)

        with system.open_input_file(name) as file:
            found = read_records(file, file.size(), name.endswith(".gz"), wanted, "payload" in self.names)
            for headers, payload in found:
                rows.append([payload if n == "payload" else headers.get(HEADERS[n].lower()) for n in self.names])
                held += 500 + len(payload or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class WarcFiles(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], most_bytes: int, level: int) -> None:
        self.path, self.names, self.most_bytes, self.level = path, names, most_bytes, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcFiles:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.most_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    data = gzip_member(self.record(row), self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return WarcFiles(names)

    @staticmethod
    def record(row: dict[str, Any]) -> bytes:
        kind, payload = row.get("record_type") or "response", row.get("payload") or b""
        headers = {HEADERS[c]: row[c] for c in HEADERS if row.get(c) is not None} | {"WARC-Type": kind}
        if kind in ("response", "revisit"):
            headers |= {"Content-Type": HTTP_TYPE}
            length = row.get("payload_length") or len(payload)
            block = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'application/octet-stream'}\r\nContent-Length: {length}\r\n\r\n".encode()
            block += payload if kind == "response" else b""
            if kind == "revisit":
                headers |= {"WARC-Profile": SAME_PAYLOAD}
        else:
            block = payload
        return record_bytes(headers, block)

    def commit(self, messages: list[WarcFiles | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[WarcFiles | None]) -> None:
        system, root = _open(self.path)
        for m in messages:
            for n in m.names if m else []:
                if system.get_file_info(f"{root}/{n}").type == pafs.FileType.File:
                    system.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    """Options: ``path``; writing: ``maxFileBytes`` (32 MiB) and ``level`` of gzip (6)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        system, root = _open(self.options["path"])
        if not overwrite and system.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            raise FileExistsError(self.options["path"])
        return WarcWriter(self.options["path"], schema.names, int(self.options.get("maxFileBytes", 32 << 20)), int(self.options.get("level", 6)))


def register(spark: SparkSession) -> None:
    """Make ``warc`` known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
