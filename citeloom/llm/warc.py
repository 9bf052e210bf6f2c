"""WARC archives packed in ZIP files: a writer, and a reader that never extracts.

The reader takes a size and a function that reads ranges.  It finds the end of
central directory record (and its ZIP64 form), parses the central directory,
resolves the data range of stored members from their local headers, reads the
index member, and then fetches each record by one range inside the archive
member.  Members that are compressed as a whole cannot be read by ranges and
are refused.

Archives are files of the shared folder, one after another from each task.  A
task that is run again writes files of other names, and only those that its
table of paths names are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.storage import bounded_batches, new_path, written

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records are rolled into a new archive beyond so many bytes.
ARCHIVE_BYTES = 4 << 20
#: Archives that one reading task gets, by their bytes, unless that makes too many tasks.
TASK_BYTES, MOST_TASKS = 16 << 20, 50_000
SALTS = 16
_URN, _DATE = "urn:page:", "2024-01-01T00:00:00Z"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    for one, other in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = uri.replace(one, other, 1) if uri.startswith(one) else uri
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class ArchiveError(ValueError):
    """The bytes are no archive that this reader reads."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class ZipRanges:
    """Stored members of a ZIP file, by ranges: ``read_at(offset, length) -> bytes``."""

    def __init__(self, size: int, read_at: Callable[[int, int], bytes]):
        self._size, self._read_at = size, read_at
        self.members = {m.name: m for m in self._directory()}

    @classmethod
    def of_bytes(cls, data: bytes) -> ZipRanges:
        view = memoryview(data)
        return cls(len(data), lambda at, n: bytes(view[at : at + n]))

    @classmethod
    @contextmanager
    def of_file(cls, uri: str) -> Iterator[ZipRanges]:
        """The archive in a file of any store that pyarrow opens, by seeks."""
        store, path = store_of(uri)
        with store.open_input_file(path) as file:
            yield cls(file.size(), lambda at, n: file.read_at(n, at))

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and offset of the central directory."""
        tail_at = max(0, self._size - 65557)
        tail = self._read_at(tail_at, self._size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0 or at + 22 > len(tail):
            raise ArchiveError("no end of central directory")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if entries == 0xFFFF or 0xFFFFFFFF in (size, offset):
            locator = self._read_at(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ArchiveError("no ZIP64 locator")
            end = self._read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ArchiveError("no ZIP64 end of central directory")
            entries, size, offset = struct.unpack_from("<QQQ", end, 32)
        return entries, size, offset

    def _directory(self) -> Iterator[Member]:
        entries, size, offset = self._end()
        raw, at = self._read_at(offset, size), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ArchiveError("central directory entry expected")
            (method,) = struct.unpack_from("<H", raw, at + 10)
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
            (header_at,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            wide = self._zip64(extra, [full == 0xFFFFFFFF, packed == 0xFFFFFFFF, header_at == 0xFFFFFFFF])
            full = wide.pop(0) if full == 0xFFFFFFFF else full
            packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
            header_at = wide.pop(0) if header_at == 0xFFFFFFFF else header_at
            yield Member(name, method, packed, header_at)
            at += 46 + n_name + n_extra + n_note

    @staticmethod
    def _zip64(extra: bytes, wanted: list[bool]) -> list[int]:
        at = 0
        while any(wanted) and at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                return list(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
            at += 4 + n
        if any(wanted):
            raise ArchiveError("no ZIP64 sizes")
        return []

    def data_at(self, name: str) -> int:
        """Where the bytes of a stored member begin in the file."""
        member = self.members.get(name)
        if member is None or member.method:
            raise ArchiveError(f"no stored member {name}")
        head = self._read_at(member.header_at, 30)
        if head[:4] != b"PK\x03\x04":
            raise ArchiveError("local header expected")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.header_at + 30 + n_name + n_extra

    def read(self, name: str, at: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        begin, size = self.data_at(name), self.members[name].size
        return self._read_at(begin + at, size - at if length is None else min(length, size - at))


@dataclass(frozen=True)
class Record:
    """One WARC record: its headers by lower-case name, and its block."""

    headers: dict[str, str]
    block: bytes

    @classmethod
    def parse(cls, raw: bytes) -> Record:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ArchiveError("WARC record expected")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        return cls(headers, rest[: int(headers["content-length"])])

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and body of the block's HTTP message."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


class PackedWarc:
    """Records of a ZIP-packaged WARC, by its index."""

    def __init__(self, archive: ZipRanges, data: str = DATA_MEMBER, index: str = INDEX_MEMBER):
        self._archive, self._data = archive, archive.data_at(data)
        self.entries = [json.loads(line.split(" ", 2)[2]) for line in archive.read(index).decode("utf-8").splitlines()]

    def record(self, entry: dict) -> Record:
        """One range read, one gzip member."""
        raw = self._archive._read_at(self._data + int(entry["offset"]), int(entry["length"]))
        return Record.parse(zlib.decompress(raw, 31))

    def __iter__(self) -> Iterator[Record]:
        return map(self.record, self.entries)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(value: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, dict]:
    """A gzip member with one record, and its index entry but for offset and length.

    A revisit keeps the HTTP headers of its page, with the payload's length, and no payload.
    """
    revisit = refers_to is not None
    name, code = "" if page_id is None else str(page_id), digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_URN}{name}>"), ("WARC-Date", _DATE)]
    headers += [("WARC-Target-URI", _plain(url))] if url else []
    headers += [("WARC-Payload-Digest", f"sha1:{code}"), ("Content-Type", "application/http;msgtype=response")]
    headers += [("WARC-Refers-To", f"<{_URN}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []
    headers.append(("Content-Length", str(len(block))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 4, mtime=0), {"url": _plain(url or ""), "digest": code, "filename": DATA_MEMBER}


def pack_archive(records: list[tuple[bytes, dict]]) -> bytes:
    """A ZIP file with the records in one stored member and their index in another."""
    at, lines = 0, []
    for raw, entry in records:
        lines.append(f"{entry['url'] or '-'} {_DATE} " + json.dumps(entry | {"offset": at, "length": len(raw)}))
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as packed:
        for name, body in ((DATA_MEMBER, b"".join(r for r, _ in records)), (INDEX_MEMBER, "\n".join(lines).encode())):
            with packed.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(body)
    return out.getvalue()


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html and first_id: the smallest page_id with an equal payload (null if it has no equal).

    Payloads meet as digests: groups are counted before the shuffle, and those
    of one page take no part in the join, whose large groups are salted.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("html")), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS))})
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1")
    groups = groups.select("digest", "first_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.join(groups, ["digest", "salt"], "left").select("page_id", "url", "html", "first_id")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``with_first`` into archives of about ARCHIVE_BYTES in ``folder``; a row for each: uri, bytes and records."""

    def saved(records: list[tuple[bytes, dict]]) -> pd.DataFrame:
        uri, data = f"{folder}/{uuid.uuid4().hex}.wacz", pack_archive(records)
        store, path = store_of(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(data)
        return pd.DataFrame({"uri": [uri], "bytes": [len(data)], "records": [len(records)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records, size = [], 0
        for batch in batches:
            for page_id, url, html, first in zip(batch["page_id"], batch["url"], batch["html"], batch["first_id"], strict=True):
                page, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                refers = first if first is not None and page != first else None
                records.append(build_record(page, url if isinstance(url, str) else None, html.encode("utf-8", "surrogatepass"), refers))
                size += len(records[-1][0])
                if size >= ARCHIVE_BYTES:
                    yield saved(records)
                    records, size = [], 0
        if records:
            yield saved(records)

    return rows.select(F.col("page_id").cast("string"), "url", "html", F.col("first_id").cast("string")).mapInPandas(run, "uri string, bytes long, records long")


RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archive files in column ``uri``; a payload that is there is held against its digest."""

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").removeprefix(_URN)
        return int(tail) if tail.lstrip("-").isdigit() else None

    def row(record: Record) -> tuple:
        head, body = record.http()
        code = record.headers["warc-payload-digest"].removeprefix("sha1:")
        kind = record.headers["warc-type"]
        size = int(head["content-length"])
        if kind == "response" and (digest(body) != code or len(body) != size):
            raise ArchiveError("payload and digest differ")
        return number(record.headers["warc-record-id"]), size, code, kind, number(record.headers.get("warc-refers-to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                with ZipRanges.of_file(uri) as archive:
                    rows = [row(r) for r in PackedWarc(archive)]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("uri").mapInPandas(run, RECORD_SCHEMA)


def check_revisits(records: DataFrame) -> None:
    """Every revisit must have a response with its page_id, length and digest; ArchiveError if one has not.

    Revisits of one response are one row before anything is shuffled.
    """
    own = ["payload_digest", "payload_bytes"]
    asked = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *own).distinct()
    there = records.filter("record_type = 'response'").select("page_id", *own)
    if lost := asked.join(there, ["page_id", *own], "left_anti").head():
        raise ArchiveError(f"no response for the revisits of {lost.page_id}")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write a record for every page into ZIP-packaged WARC files, then read them back by ranges.

    Null html is an empty payload.  Of equal payloads the smallest page_id is
    the response (every row that carries it, if it repeats), the others are
    revisits of it; rows without page_id refer to it too, and are responses if
    no row of the group has one.  An empty table gives an empty table.
    """
    bounded_batches(pages.sparkSession)
    files = written(write_archives(with_first(pages), new_path(pages.sparkSession, "warc")), "warc-files")
    tasks = files.agg(F.sum("bytes")).first()[0] or 0
    records = written(read_archives(files.repartition(min(MOST_TASKS, 1 + tasks // TASK_BYTES))), "warc-records")
    check_revisits(records)
    return records
