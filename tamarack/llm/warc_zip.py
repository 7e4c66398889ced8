"""WARC records in ZIP packages: written by tasks, read back by ranges without extraction."""

from __future__ import annotations

import gzip
import itertools
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import Scratch, keys_for_join, map_arrow

#: A task starts a new archive once one holds so many bytes of records.
ARCHIVE_BYTES = 256 << 20
#: Index entries per unit of reading work, and the gap up to which neighbouring ranges are read in one request.
ENTRIES = 2000
GAP, REQUEST = 64 << 10, 8 << 20

#: Names of the members that are written; those read are found by the endings of their names.
RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
ARCHIVE_ENDS, INDEX_ENDS = (".warc.gz", ".warc"), (".cdxj", ".cdx")
WRITTEN = "20200101000000"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 40 bits are eight digits to the base 32, then put into the base32 alphabet."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), payload as stored, and the payload's full length, of a record compressed or not.

    Of an HTTP block the payload is what follows its header, and its length is that of the header's
    Content-Length, or as stored where there is none; any other block is the payload itself.
    """
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not headers.get("content-length", "").isdigit():
        raise ValueError("the record has no length")
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("the record is cut short")
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, block, len(block)
    http, _, payload = block.partition(b"\r\n\r\n")
    told = [v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    return headers, payload, int(told[0]) if told and told[0].isdigit() else len(payload)


def _surt(url: str | None) -> str:
    """A sort-friendly key of an index line: the host's labels reversed, then the path; without white space."""
    scheme, _, rest = (url or "").partition("://")
    host, slash, path = rest.partition("/")
    key = f"{','.join(reversed(host.lower().split('.')))}){slash}{path}" if rest else scheme
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in key) or "-"


def index_entry(line: bytes) -> dict:
    """The fields of an index line ``key timestamp {json}``, or of a bare JSON line."""
    found = json.loads(line[line.index(b"{") :])
    return found | {"offset": int(found["offset"]), "length": int(found["length"])}


def _roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int, scratch: Scratch) -> DataFrame:
    """page, url, payload, digest, refers_to, kind of each row; only digests and ids are grouped.

    The digests that occur more than once, with their first page, are sent to the payloads up to a
    bound of bytes; beyond it they are joined by a shuffle, whose large partitions Spark splits.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", payload_digest(F.col("payload")))
    eligible = F.octet_length("payload") >= least_bytes
    first = source.where(eligible).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = source.join(keys_for_join(scratch.cut(first, "first")), "digest", "left")
    revisit = eligible & F.coalesce(F.col("page") != F.col("first"), F.col("first").isNotNull())
    return joined.select("page", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("kind"))


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a WARC record per row into ZIP packages below ``folder`` (a shared place); rows: ``path``, ``records``.

    Of the records with equal payloads of at least ``least_bytes`` bytes, that with the smallest
    page id is a response and the others revisit it; smaller payloads are responses. A package
    holds the stored members ``archive/data.warc.gz``, each record compressed by itself, and
    ``indexes/index.cdxj`` (lines ``key timestamp {json}``), in that order.

    Null html is an empty payload; rows of a null id revisit a row that has one, if they can,
    and are responses else; rows that repeat the smallest id are responses each; a very long
    payload is one record, held whole by one task; other columns are not read; an empty table gives
    no archive. Every attempt of a task writes names of its own, and only those of the
    attempts that succeeded are returned, so a lost executor leaves nothing half-written in them.
    """
    rows = _roles(pages, id_col, url_col, html_col, least_bytes, Scratch(pages.sparkSession, "warc-roles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made: list[tuple[str, int]] = []
        archive = member = None
        index: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal archive, member
            if archive is not None:
                member.close()
                archive.writestr(INDEX, b"".join(index))
                archive.close()
                stream.close()
                archive = member = None

        for batch in batches:
            for page, url, payload, digest, refers_to, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    stream = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = archive.open(RECORDS, "w", force_zip64=True)
                    index, size = [], 0
                    made.append((name, 0))
                data = gzip.compress(_record(page, url, payload, digest, refers_to, kind), 1, mtime=0)
                member.write(data)
                entry = {"url": url or "urn:none", "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(data)), "offset": str(size), "filename": RECORDS.rpartition("/")[2]}
                index.append(f"{_surt(url)} {WRITTEN} {json.dumps(entry)}\n".encode())
                size += len(data)
                made[-1] = (made[-1][0], made[-1][1] + 1)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{n}" for n, _ in made], pa.string()), pa.array([k for _, k in made], pa.int64())], names=["path", "records"])

    return map_arrow(rows, run, "path string, records long")


@dataclass
class Member:
    name: str
    header: int
    compressed: int
    size: int
    method: int


class Package:
    """A ZIP package in any file system: its directory is read, and then ranges of stored members."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)
        self.size = self.file.size()
        self.members = {m.name: m for m in self._directory()}

    def close(self) -> None:
        self.file.close()

    def read_at(self, at: int, length: int) -> bytes:
        data = self.file.read_at(length, at)
        if len(data) != length:
            raise ValueError("the package is cut short")
        return data

    def _directory(self) -> Iterator[Member]:
        """The members by the central directory, found from the end record, or from its ZIP64 form."""
        tail_at = max(0, self.size - 22 - 65535)
        tail = self.read_at(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\5\6", 0, end)  # the signature may stand in the comment
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = self.read_at(tail_at + end - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            record = self.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        data, at = self.read_at(start, length), 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\1\2":
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            compressed, size, n, m, k = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name, extra = data[at + 46 : at + 46 + n], data[at + 46 + n : at + 46 + n + m]
            e = 0
            while e + 4 <= len(extra):
                tag, long = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: only those that do not fit, in this order
                    values = iter(struct.unpack_from(f"<{long // 8}Q", extra, e + 4))
                    size = next(values) if size == 0xFFFFFFFF else size
                    compressed = next(values) if compressed == 0xFFFFFFFF else compressed
                    header = next(values) if header == 0xFFFFFFFF else header
                e += 4 + long
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), header, compressed, size, method)
            at += 46 + n + m + k

    def ending(self, ends: tuple[str, ...]) -> list[str]:
        """The members whose names end so, in the order of the central directory."""
        return [n for n in self.members if n.lower().endswith(ends)]

    def archive_of(self, filename: str | None) -> str:
        """The archive member that an index entry names, by its whole name or the last part of it; where there is one only, no name is needed."""
        every = self.ending(ARCHIVE_ENDS)
        if not filename and len(every) == 1:
            return every[0]
        found = [n for n in every if n == filename] or [n for n in every if n.rpartition("/")[2] == (filename or "").rpartition("/")[2]]
        if len(found) != 1:
            raise ValueError(f"no single archive member {filename!r}")
        return found[0]

    def start_of(self, name: str) -> int:
        """Where a stored member's bytes start; its local header is read for the lengths of name and extra field."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        local = self.read_at(member.header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError("the local header is damaged")
        n, m = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + n + m

    def read(self, name: str, at: int, length: int) -> bytes:
        if at < 0 or at + length > self.members[name].size:
            raise ValueError(f"range beyond {name}")
        return self.read_at(self.start_of(name) + at, length)

    def ranges(self, name: str, wanted: list[tuple[int, int]]) -> Iterator[bytes]:
        """The bytes of (offset, length) ranges in order; neighbours share a request of at most REQUEST bytes."""
        base, k = self.start_of(name), 0
        while k < len(wanted):
            start, end, j = wanted[k][0], sum(wanted[k]), k + 1
            while j < len(wanted) and 0 <= wanted[j][0] - end <= GAP and sum(wanted[j]) - start <= REQUEST:
                end, j = sum(wanted[j]), j + 1
            if end > self.members[name].size:
                raise ValueError(f"range beyond {name}")
            data = self.read_at(base + start, end - start)
            for at, length in wanted[k:j]:
                yield data[at - start : at - start + length]
            k = j


def plan_reads(archives: DataFrame, *, entries: int = ENTRIES) -> DataFrame:
    """path, member, from, to: stretches of the archives' indexes, as units of work of even size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                package = Package(path)
                indexes = package.ending(INDEX_ENDS)
                if not indexes and package.ending(ARCHIVE_ENDS):
                    raise ValueError(f"no index in {path}")
                for name in indexes:
                    length, start, at, lines, carry = package.members[name].size, 0, 0, 0, 0
                    while at < length:  # the index is read in stretches; only where its lines end is kept
                        part = package.read(name, at, min(REQUEST, length - at))
                        last = at + len(part) == length
                        ends = part.rfind(b"\n") + 1
                        if not ends and not last:
                            raise ValueError("an index line is too long")
                        for line in (part if last else part[:ends]).splitlines(keepends=True):
                            carry += len(line)
                            lines += 1
                            if lines == entries:
                                found.append((path, name, start, carry))
                                start, lines = carry, 0
                        at += len(part) if last else ends  # a line that is cut is read again
                    if carry > start:
                        found.append((path, name, start, carry))
                package.close()
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "member", "start", "end"])

    return map_arrow(archives.select("path"), run, "path string, member string, start long, end long")


RECORD_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_records(archives: DataFrame, *, entries: int = ENTRIES, payloads: bool = True) -> DataFrame:
    """One row per record of the archives (``path``), by range reads along their indexes.

    Index and archive members are found in each package's central directory by the endings of their
    names; an index line names its archive. ``payload`` is as stored (empty for revisits; null
    without ``payloads``), digest and length are of the full payload; what a record does not say is
    null (the page id where the record's id is none of ours). A damaged package or record, a
    compressed member, and a package with archives but no index raise ValueError.
    """
    work = plan_reads(archives, entries=entries)
    context = archives.sparkSession.sparkContext
    spread = work.repartition(max(2 * context.defaultParallelism, 8), "path", "member", "start")

    def page_of(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, index, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = Package(path)
                lines = [index_entry(x) for x in package.read(index, start, end - start).splitlines() if b"{" in x]
                rows, held = [], 0
                for name, own in itertools.groupby(lines, lambda x: package.archive_of(x.get("filename"))):
                    for data in package.ranges(name, [(x["offset"], x["length"]) for x in own]):
                        head, payload, length = parse_record(data)
                        digest = head.get("warc-payload-digest")
                        rows.append((page_of(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-type"), digest.removeprefix("sha1:") if digest else None, length, page_of(head.get("warc-refers-to")), payload if payloads else None))
                        held += len(data) + len(payload)
                        if held > REQUEST:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                package.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(spread, run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, *, least_bytes: int = 0, **options) -> DataFrame:
    """Write ``pages`` into archives in the shared folder, and read their records back."""
    scratch = Scratch(pages.sparkSession, "warc")
    context = pages.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(scratch.path("archives"))
    folder = at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString()  # with the scheme of the file system that Spark uses
    folder = f"file://{folder.removeprefix('file:')}" if folder.startswith("file:/") and not folder.startswith("file://") else folder
    archives = scratch.cut(write_archives(pages, folder, least_bytes=least_bytes, **options), "manifest")
    return read_records(archives)
