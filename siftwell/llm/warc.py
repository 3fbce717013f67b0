"""WARC records in ZIP-packaged archives: written from pages, and read back by ranges without extraction.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, one line per record with its place in the former. The reader parses the end of the file, the
ZIP64 records and the central directory, finds where the members lie, and reads records by their byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import cut, scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures, and what stands in for a number that a ZIP64 field holds.
END, END64, END64_AT, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
ELSEWHERE32, ELSEWHERE16 = 0xFFFFFFFF, 0xFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Member:
    name: str
    start: int
    size: int
    stored: bool


def members(file: BinaryIO) -> list[Member]:
    """The members of a ZIP file by its central directory; only its end, the directory and local headers are read."""
    file.seek(0, os.SEEK_END)
    length = file.tell()
    tail_at = max(0, length - 22 - 0xFFFF - 20)
    file.seek(tail_at)
    tail = file.read(length - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == END64_AT:
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        file.seek(end64)
        record = file.read(56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    file.seek(start)
    directory, out, at = file.read(size), [], 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, packed, full, n, extra, comment, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name, fields = directory[at + 46 : at + 46 + n].decode("utf-8", "replace"), directory[at + 46 + n : at + 46 + n + extra]
        wide = []
        while len(fields) >= 4:
            kind, long = struct.unpack_from("<HH", fields)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{long // 8}Q", fields, 4))
            fields = fields[4 + long :]
        full = wide.pop(0) if full == ELSEWHERE32 else full
        packed = wide.pop(0) if packed == ELSEWHERE32 else packed
        local = wide.pop(0) if local == ELSEWHERE32 else local
        file.seek(local)
        header = file.read(30)
        if header[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        own_name, own_extra = struct.unpack_from("<HH", header, 26)
        out.append(Member(name, local + 30 + own_name + own_extra, packed, method == 0))
        at += 46 + n + extra + comment
    return out


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> tuple[bytes, str, str]:
    """One record, its type and payload digest. ``first`` is the page whose response a revisit refers to.

    A revisit keeps the HTTP headers, and with them the payload's length, but no payload.
    """
    digest, kind = digest_of(payload), "response" if first is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if first is not None:
        head += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", kind, digest


def page_of(urn: str) -> int | None:
    """The page that a record id of ours stands for; other archives' ids stand for none."""
    kind, _, number = urn.strip("<>").rpartition(":")
    return int(number) if kind == "urn:x-page" and number.isdecimal() else None


def parsed(data: bytes) -> dict:
    """Type, ids, target, payload length and digest of one record; those of records with a payload come from the payload itself.

    A response's payload is the body of its HTTP message, that of other records (information, requests, metadata) their block. A revisit
    has the length that its HTTP headers state, if any, and the digest that it was given.
    """
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, given = fields["warc-type"], fields.get("warc-payload-digest", "")
    if kind == "revisit":
        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        digest = given.rpartition(":")[2] or None
    else:
        payload = payload if kind == "response" and block.startswith(b"HTTP/") else block
        size, digest = len(payload), digest_of(payload)
        if kind == "response" and given.lower().startswith("sha1:") and given[5:].upper() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    own, refers = fields["warc-record-id"], fields.get("warc-refers-to")
    return {
        "page_id": page_of(own), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page_of(refers) if refers else None, "record_id": own, "refers_id": refers,
    }


class Archive:
    """One archive in the making; records go to it one by one, the index is kept until it is closed."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.path = path
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes, entry: dict) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        piece = packer.compress(raw) + packer.flush()
        self.data.write(piece)
        self.index.append(json.dumps(entry | {"offset": self.size, "length": len(piece)}).encode())
        self.size += len(piece)

    def close(self) -> int:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in self.index:
                index.write(line + b"\n")
        self.zip.close()
        self.out.close()
        return len(self.index)


def write_archives(pages: DataFrame, folder: str, target_bytes: int = 1 << 28, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as archives of about ``target_bytes`` in a shared ``folder``; one row (path, records) each.

    Of pages with equal payloads of at least ``min_revisit_bytes`` the one with the smallest page_id is the response, rows
    with that same id included; the others are revisits, also those without an id if another has one. A null html is an
    empty payload. A task streams its rows into files of its own attempt's name; only files of attempts that succeeded
    are listed, so a lost executor leaves nothing that would be read.
    """
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], payload.alias("html"), F.sha1(F.encode(payload, "UTF-8")).alias("sha1"))
    firsts = rows.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = cut(firsts.filter("n > 1").select("sha1", "first"))
    marked = rows.join(firsts, "sha1", "left").select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        open_one, made = None, []
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_one is None:
                    open_one = Archive(fs, f"{base}/{uuid.uuid4().hex}.wacz")
                raw, kind, digest = record(page_id, url, html.encode("utf-8", "surrogatepass"), first, date)
                open_one.add(raw, {"url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "digest": f"sha1:{digest}", "filename": DATA})
                if open_one.size >= target_bytes:
                    made.append((open_one.path, open_one.close()))
                    open_one = None
        if open_one is not None:
            made.append((open_one.path, open_one.close()))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return cut(marked.mapInArrow(run, "path string, records long"))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_id string"
READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_id", pa.string())])


def lines_of(file: BinaryIO, member: Member, step: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a stored member, read in steps; one that is itself compressed (gzip) is unpacked on the way."""
    at, rest, end = member.start, b"", member.start + member.size
    unpack = zlib.decompressobj(31) if member.name.endswith(".gz") else None
    while at < end:
        file.seek(at)
        data = file.read(min(step, end - at))
        at += len(data)
        if unpack is not None:
            packed, data = data, b""
            while packed:
                data += unpack.decompress(packed)
                packed = unpack.unused_data
                if unpack.eof:  # members of a gzip file follow each other
                    unpack = zlib.decompressobj(31)
        *full, rest = (rest + data).split(b"\n")
        yield from full
    if rest:
        yield rest


def places(file: BinaryIO, found: list[Member]) -> dict[str, list[tuple[int, int]]]:
    """Offset and length of the indexed records of each WARC file (by its base name), in order.

    Lines are JSON or ``urlkey timestamp JSON``, whose numbers may be strings; those of other forms (headers) are passed by.
    """
    out: dict[str, set[tuple[int, int]]] = {}
    for member in found:
        if member.name.startswith("indexes/") and member.name.removesuffix(".gz").rpartition(".")[2] in ("cdxj", "cdx"):
            if not member.stored:
                raise ValueError(f"{member.name} must be stored")
            for line in lines_of(file, member):
                at = line.find(b"{")
                if at < 0 or line.startswith(b"!"):
                    continue
                entry = json.loads(line[at:])
                if "offset" in entry and "length" in entry:
                    out.setdefault(os.path.basename(entry["filename"]), set()).add((int(entry["offset"]), int(entry["length"])))
    return {name: sorted(at) for name, at in out.items()}


def byte_ranges(at: list[tuple[int, int]], range_bytes: int) -> Iterator[tuple[int, list[int]]]:
    """Runs of records that lie side by side, as a start and their lengths, of about so many bytes."""
    start, end, sizes = 0, 0, []
    for offset, length in at:
        if sizes and (offset != end or offset + length - start > range_bytes):
            yield start, sizes
            sizes = []
        if not sizes:
            start = offset
        sizes.append(length)
        end = offset + length
    if sizes:
        yield start, sizes


def read_archives(manifest: DataFrame, folder: str, range_bytes: int = 1 << 22) -> DataFrame:
    """Every indexed record of the archives in ``manifest`` (path): first the indexes give byte ranges of about ``range_bytes``, then
    the ranges are spread over the tasks, each read in one go and cut into its records.

    Archives may hold any number of stored WARC files, packed record by record or not at all, and of indexes, which may be packed. ``page_id``
    and ``refers_to`` are null for records that ``write_archives`` didn't write; ``record_id`` and ``refers_id`` are as they stand.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as file:
                    found = members(file)
                    warcs = {os.path.basename(m.name): m for m in found if m.name.startswith("archive/")}
                    ranges: list[tuple[str, int, list[int]]] = []
                    for name, at in places(file, found).items():
                        if name not in warcs:
                            raise ValueError(f"{path}: no {name}, which the index names")
                        if not warcs[name].stored:
                            raise ValueError(f"{path}: {name} must be stored")
                        ranges += [(path, warcs[name].start + start, sizes) for start, sizes in byte_ranges(at, range_bytes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in ranges], pa.string()), pa.array([r[1] for r in ranges], pa.int64()), pa.array([r[2] for r in ranges], pa.list_(pa.int64()))], names=["path", "start", "sizes"]
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as file:
                    file.seek(start)
                    data, at, rows = file.read(sum(sizes)), 0, []
                for size in sizes:
                    piece = data[at : at + size]
                    rows.append(parsed(zlib.decompress(piece, 31) if piece[:2] == b"\x1f\x8b" else piece))
                    at += size
                yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)

    ranges = cut(manifest.select("path").mapInArrow(locate, "path string, start long, sizes array<long>"))
    tasks = max(1, -(-ranges.count() // 8))  # a given number, for rows that stand for megabytes must not be coalesced
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, READ)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives among the shared intermediate data; it goes when the application ends."""
    return f"{scratch(spark)}/archives-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written as archives and read back: one row per record."""
    folder = folder or archive_folder(pages.sparkSession)
    return read_archives(write_archives(pages, folder), folder)
