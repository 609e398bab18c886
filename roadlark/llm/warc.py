"""Web archives packed in ZIP files: a writer, and a reader that never extracts.

An archive is a ZIP whose members are stored uncompressed: `archive/data.warc.gz`, one gzip member
for each record, and `indexes/index.cdxj`, one line for each record with its place. The reader looks
for the end of the ZIP's directory, follows the ZIP64 directory where there is one, finds where each
stored member's bytes begin, reads the index, and then reads records by their byte range.

Archives lie in a folder that all executors share and are opened by `pyarrow.fs`, which has local,
HDFS and object stores. A task that is run again writes new files; only those in the manifest count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, tidy

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed payload of one archive, about; bounds the memory of a writing task.
ARCHIVE_BYTES = 24 << 20
#: Tasks that read archives, at most.
MOST_TASKS = 50_000

# Fixed values of the ZIP format: signatures and sizes.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR64_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE, LONGEST_COMMENT = 22, 20, 56, 46, 30, 65535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record with its HTTP response; a revisit has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {quote(url or f'urn:page:{page_id}', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (both with lower-case names) and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class ArchiveWriter:
    """Collects records in memory and writes one ZIP."""

    def __init__(self, level: int = 1):
        self.level, self.size, self.count = level, 0, 0
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        raw = packer.compress(warc_record(page_id, url, payload, digest, refers_to, date)) + packer.flush()
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.data.tell(), "length": len(raw)}))
        self.data.write(raw)
        self.size += len(payload)
        self.count += 1

    def bytes(self, zip64: bool = False) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, content in ((DATA, self.data.getvalue()), (INDEX, "\n".join(self.lines).encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                    f.write(content)
        return out.getvalue()


@dataclass(frozen=True)
class Member:
    name: str
    header: int
    size: int
    method: int


class ZipArchive:
    """The directory of a ZIP read by ranges. `source` has size() and read_at(count, offset)."""

    def __init__(self, source):
        self.source, self.length = source, source.size()
        self.members = {m.name: m for m in self._directory()}

    def _read(self, offset: int, count: int) -> bytes:
        if offset < 0 or offset + count > self.length:
            raise ValueError("the ZIP directory points outside the file")
        return self.source.read_at(count, offset)

    def _end(self) -> tuple[int, int, int, int]:
        """Offset of the end record, entries, and size and offset of the directory."""
        tail_at = max(0, self.length - END_SIZE - LONGEST_COMMENT)
        tail = self._read(tail_at, self.length - tail_at)
        at = tail.rfind(END)
        while at >= 0:
            if len(tail) - at >= END_SIZE:
                _, disk, first, here, total, size, offset, comment = struct.unpack_from("<4s4H2LH", tail, at)
                if at + END_SIZE + comment == len(tail) and ((disk == first and here == total) or FULL16 in (disk, here, total)):
                    return tail_at + at, total, size, offset
            at = tail.rfind(END, 0, at)
        raise ValueError("no end of a ZIP directory")

    def _directory(self) -> Iterator[Member]:
        end, total, size, offset = self._end()
        if end >= LOCATOR64_SIZE and (locator := self._read(end - LOCATOR64_SIZE, LOCATOR64_SIZE)).startswith(LOCATOR64):
            (at64,) = struct.unpack_from("<Q", locator, 8)
            record = self._read(at64, END64_SIZE)
            if not record.startswith(END64):
                raise ValueError("no ZIP64 directory where its locator points")
            total, size, offset = struct.unpack_from("<QQQ", record, 32)
        elif FULL16 == total or FULL32 in (size, offset):
            raise ValueError("the ZIP64 directory is missing")
        raw, at = self._read(offset, size), 0
        for _ in range(total):
            if raw[at : at + 4] != ENTRY:
                raise ValueError("a directory entry is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, plain, name_len, extra_len, comment_len = struct.unpack_from("<LLHHH", raw, at + 20)
            (header,) = struct.unpack_from("<L", raw, at + 42)
            name = raw[at + ENTRY_SIZE : at + ENTRY_SIZE + name_len].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + ENTRY_SIZE + name_len : at + ENTRY_SIZE + name_len + extra_len]
            plain, packed, header = _wide(extra, plain, packed, header)
            yield Member(name, header, packed, method)
            at += ENTRY_SIZE + name_len + extra_len + comment_len

    def start(self, member: Member) -> int:
        """Where a stored member's bytes begin: its own header may have another extra field than the directory."""
        local = self._read(member.header, LOCAL_SIZE)
        if not local.startswith(LOCAL):
            raise ValueError(f"no member where the directory has {member.name}")
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{member.name} is compressed in the ZIP and can't be read by ranges")
        name_len, extra_len = struct.unpack_from("<HH", local, 26)
        return member.header + LOCAL_SIZE + name_len + extra_len

    def read(self, name: str, offset: int = 0, count: int | None = None) -> bytes:
        member = self.members[name]
        count = member.size - offset if count is None else count
        if offset < 0 or count < 0 or offset + count > member.size:
            raise ValueError(f"the range is outside {name}")
        return self._read(self.start(member) + offset, count)


def _wide(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int, int]:
    """The three numbers, from the ZIP64 extra field (id 1) where they did not fit 32 bits; it has just those, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return tuple(next(wide) if x == FULL32 else x for x in (plain, packed, header))  # type: ignore[return-value]
        at += 4 + size
    return plain, packed, header


class _File:
    def __init__(self, file):
        self.file = file

    def size(self) -> int:
        return self.file.size()

    def read_at(self, count: int, offset: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(count)


def records(source) -> Iterator[tuple[dict, dict[str, str], dict[str, str], bytes]]:
    """Every record of an archive by its index: the index line, WARC headers, HTTP headers, payload."""
    archive = ZipArchive(source)
    base = archive.start(archive.members[DATA])
    size = archive.members[DATA].size
    for line in archive.read(INDEX).splitlines():
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > size:
            raise ValueError("the index points outside the archive's data")
        raw = source.read_at(entry["length"], base + entry["offset"])
        yield entry, *parse_record(zlib.decompress(raw, 31))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def first_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages whose payload a smaller page_id has as well; one row for each."""
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), payload_sha(), F.octet_length(payload()).alias("size")).where(F.col("size") >= least_bytes)
    firsts = keys.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    return keys.select("page_id", "sha").join(firsts.select("sha", "refers_to"), "sha").where("page_id > refers_to").distinct()


def payload():
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def payload_sha():
    return F.sha1(payload().cast("binary")).alias("sha")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each row of pages as a record; returns the manifest (path, n_records, n_bytes), which is to be kept before it is read.

    Null payloads are empty. Of equal payloads of at least least_bytes the smallest page_id is the response, others
    revisit it; rows that repeat this page_id are responses too. A null page_id is never a revisit. A null url gets a name.
    """
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload().alias("html"), payload_sha())
    told = whole.join(first_copies(pages, least_bytes), ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)

        def close(writer: ArchiveWriter):
            name = f"{uuid.uuid4().hex}.wacz"
            content = writer.bytes()
            with filesystem.open_output_stream(f"{base}/{name}") as out:
                out.write(content)
            return pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "n_records": [writer.count], "n_bytes": [len(content)]})

        writer = ArchiveWriter()
        for batch in chunks(batches, "html", archive_bytes):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                body = html.encode("utf-8", "surrogatepass")
                writer.add(page_id, url, body, digest32(body), refers_to, date)
                if writer.size >= archive_bytes:
                    yield close(writer)
                    writer = ArchiveWriter()
        if writer.count:
            yield close(writer)

    return told.mapInArrow(tidy(run), "path string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    Each response is held against its digest. A revisit has the size and digest of the payload it refers to.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payloads else [])]

    def number(urn: str | None):
        return None if urn is None or urn.endswith(":None>") else int(urn.removeprefix("<urn:page:").removesuffix(">"))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, inner = _filesystem(path)
                rows: list[list] = [[] for _ in names]
                with filesystem.open_input_file(inner) as file:
                    for _, warc, http, body in records(_File(file)):
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        if warc["warc-type"] == "response" and digest32(body) != digest:
                            raise ValueError(f"{warc['warc-record-id']} in {path} differs from its digest")
                        row = (number(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"], number(warc.get("warc-refers-to")), body)
                        for column, value in zip(rows, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    # a manifest is small whatever its archives are: by number, so that no two archives share a task before MOST_TASKS are busy
    tasks = min(max(1, manifest.count()), MOST_TASKS)
    return manifest.select("path").repartition(tasks).mapInArrow(tidy(run), schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read these back."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.write(write_archives(pages, scratch.path("archives"), least_bytes), "manifest")
    return read_archives(manifest)
