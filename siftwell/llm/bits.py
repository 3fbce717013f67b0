"""Sets of hashes as tables of bits, small enough to go to every task: supersets of what is meant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import hashing

#: Bytes that reach the driver in one row.
PAGE = 1 << 12


class Bits:
    """A set of hashes as bits: a fixed size, and a superset of what is meant."""

    def __init__(self, pages: dict[int, bytes], size: int) -> None:
        self.size = size
        self.bits = np.zeros(max(size // 8, PAGE), np.uint8)  # whole pages
        for page, blob in pages.items():
            self.bits[page * PAGE : (page + 1) * PAGE] = np.frombuffer(blob, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashing.mixed(hashes) & np.uint64(self.size - 1)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bits_of(hashes: DataFrame, column: str, size: int) -> Bits:
    """The hashes of a column as a table of ``size`` bits (a power of two); it is gathered by pages, never hash by hash."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(hashing.mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
            word = slot >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first) if len(word) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(masks.view(np.int64))], names=["word", "mask"])

    words = hashes.select(column).mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    pages = words.groupBy((F.col("word") / F.lit(PAGE // 8)).cast("long").alias("page")).agg(F.collect_list(F.struct("word", "mask")).alias("words"))  # at most 512 words a page
    out = {}
    for r in pages.collect():  # the table itself: at most ``most_bits`` bits
        blob = np.zeros(PAGE // 8, np.uint64)
        for w in r["words"]:
            blob[w["word"] % (PAGE // 8)] = np.int64(w["mask"]).view(np.uint64)
        out[r["page"]] = blob.tobytes()
    return Bits(out, size)


def fitting(count: int, each: int = 16, least: int = 1 << 20, most: int = 1 << 28) -> int:
    """A power of two of at least ``each`` bits for each of ``count`` hashes, between two bounds; beyond the upper one more hashes pass by mistake."""
    size = least
    while size < min(most, each * count):
        size *= 2
    return size
