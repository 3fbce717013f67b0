"""Files of any size as byte ranges: a data source whose partitions are ranges, for batches and streams.

A file is never held as a whole: each task reads its range in small pieces. A file's fingerprint combines the hashes of its ranges in order.
The store must be one that ``pyarrow.fs`` opens; ``files.scan_files`` goes through Spark's own reader instead.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, and of the pieces that a task reads and gives out.
RANGE_BYTES, PIECE_BYTES = 64 << 20, 4 << 20
#: Bytes that a task reads at least, if there are as many: smaller ranges share a task.
TASK_BYTES = 4 << 20


@dataclass
class Range(InputPartition):
    path: str
    size: int
    modified: int
    part: int
    start: int
    end: int


def listed(path: str, pattern: str) -> list[pafs.FileInfo]:
    """Files below a path (or the file itself) whose name matches, in any case, by path. Hidden ones are left out."""
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    top = fs.get_file_info(inner)
    found = [top] if top.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
    mine = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name.lower(), pattern.lower())]
    return sorted(mine, key=lambda f: f.path)


def ranges_of(files: list[pafs.FileInfo], size: int) -> list[Range]:
    return [Range(f.path, f.size, f.mtime_ns // 1000, i, a, min(a + size, f.size)) for f in files for i, a in enumerate(range(0, max(f.size, 1), size))]


@dataclass
class Run(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[Range]


def runs_of(ranges: list[Range], size: int = TASK_BYTES) -> list[Run]:
    runs: list[Run] = []
    held = 0
    for r in ranges:
        if not runs or held + r.end - r.start > size:
            runs.append(Run([]))
            held = 0
        runs[-1].ranges.append(r)
        held += max(1, r.end - r.start)
    return runs


class _Reads:
    """Reading of one range, by the options ``path``, ``pattern``, ``range`` (bytes) and ``as``: pieces, digest or lines."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.size, self.kind = int(options.get("range", RANGE_BYTES)), options.get("as", "pieces")

    def opened(self, part: Range):  # noqa: ANN201
        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        return fs.open_input_file(part.path)

    def pieces(self, part: Range) -> Iterator[tuple[int, bytes]]:
        with self.opened(part) as f:
            at = part.start
            while at < part.end:
                piece = f.read_at(min(PIECE_BYTES, part.end - at), at)
                if not piece:
                    raise OSError(f"{part.path} became shorter while it was read")
                yield at, piece
                at += len(piece)

    def lines(self, part: Range) -> tuple[int, bytes]:
        """The lines that begin in the range, whole: the last one may go on beyond it."""
        with self.opened(part) as f:
            start = part.start
            if start:  # the line that runs into the range belongs to the one before
                start = self._after_newline(f, start - 1, part.size)
            end = self._after_newline(f, part.end - 1, part.size) if part.end < part.size else part.size
            return start, f.read_at(max(0, end - start), start) if start < end else b""

    @staticmethod
    def _after_newline(f, at: int, size: int) -> int:  # noqa: ANN001
        while at < size:
            piece = f.read_at(min(PIECE_BYTES, size - at), at)
            found = piece.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(piece)
        return size

    def read(self, part: Range) -> Iterator[tuple]:
        head = (part.path, part.size, part.modified, part.part)
        if self.kind == "digest":
            digest = hashlib.sha1(usedforsecurity=False)
            for _, piece in self.pieces(part):
                digest.update(piece)
            yield (*head, part.start, None, digest.hexdigest())
        elif self.kind == "lines":
            start, body = self.lines(part)
            if body or not part.size:
                yield (*head, start, body, None)
        else:
            for at, piece in self.pieces(part):
                yield (*head, at, piece, None)


class RangeReader(DataSourceReader, _Reads):
    def __init__(self, options: dict[str, str]):
        _Reads.__init__(self, options)

    def partitions(self) -> list[Run]:
        return runs_of(ranges_of(listed(self.path, self.pattern), self.size))

    def read(self, partition: Run) -> Iterator[tuple]:
        for part in partition.ranges:
            yield from _Reads.read(self, part)


class RangeStream(DataSourceStreamReader, _Reads):
    """Files as they come: those later than the last one, by time of change and path. A file must be complete when it appears."""

    def __init__(self, options: dict[str, str]):
        _Reads.__init__(self, options)

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.mtime_ns, f.path) for f in listed(self.path, self.pattern)), default=(-1, ""))
        return {"modified": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        after, to = (start["modified"], start["path"]), (end["modified"], end["path"])
        return runs_of(ranges_of([f for f in listed(self.path, self.pattern) if after < (f.mtime_ns, f.path) <= to], self.size))

    def read(self, partition: Run) -> Iterator[tuple]:
        for part in partition.ranges:
            yield from _Reads.read(self, part)


class ByteRanges(DataSource):
    """``path, size, modified`` (of the file), ``part, offset`` and ``content`` or ``digest`` (SHA-1) of a range."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, size long, modified long, part int, offset long, content binary, digest string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RangeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return RangeStream(self.options)


def read_ranges(spark: SparkSession, path: str, kind: str = "pieces", pattern: str = "*", range_bytes: int = RANGE_BYTES, stream: bool = False) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    reader = spark.readStream if stream else spark.read
    return reader.format("byte_ranges").option("path", path).option("pattern", pattern).option("range", range_bytes).option("as", kind).load()


def file_hashes(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, source, size, modificationTime, sha1`` of each file, however large.

    A file of one range has the SHA-1 of its bytes; that of a larger one is the SHA-1 of its ranges' SHA-1s (hexadecimal) in order.
    """
    parts = read_ranges(spark, path, "digest", pattern, range_bytes)
    # A hash for each range of a file: a row of 16 KB for a terabyte.
    files = parts.groupBy("path", "size", "modified").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda p: p["digest"]).alias("d"))
    combined = F.when(F.size("d") == 1, F.col("d")[0]).otherwise(F.sha1(F.array_join("d", "").cast("binary")))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("source"), "size", F.timestamp_micros("modified").alias("modificationTime"), combined.alias("sha1"))


def text_parts(spark: SparkSession, path: str, pattern: str = "*.txt", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Text files as documents of bounded size: ``path, source, page`` (the range), ``doc_type, date, text``, cut between lines.

    Bytes that are no UTF-8 leave their part out, as unreadable files are left out.
    """
    parts = read_ranges(spark, path, "lines", pattern, range_bytes)
    source = F.element_at(F.split("path", "/"), -1).alias("source")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("doc_type")
    out = parts.select("path", source, F.col("part").alias("page"), kind, F.to_date(F.timestamp_micros("modified")).cast("string").alias("date"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return out.filter(F.col("text").isNotNull())
