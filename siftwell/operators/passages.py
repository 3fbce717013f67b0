"""Verbatim passages: which documents contain which given texts.

A passage is cut into blocks of a fixed number of characters, the last one reaching back so that it ends with the passage.
Documents' windows of that length whose rolling hashes a table of bits knows from the passages are joined with the blocks by hash;
a document holds a passage where all of its blocks stand at their distances. Documents are read once and never leave
their tasks: what moves is a row for each window that a passage holds as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.frames import plain
from siftwell.session import materialize

#: Characters of a block; a shorter passage is one block of its own length.
WINDOW = 16
#: Bits for each block in the table, and the least and the most bits; beyond, only more windows pass by mistake.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
#: Characters that are hashed at a time.
SLICE = 1 << 20

_ODD = 0x9E3779B97F4A7C15


def window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` code points: polynomials, put together from runs of half the length."""
    n = len(points) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    held, total, step, done = points.astype(np.uint64) + np.uint64(1), None, 1, 0
    with np.errstate(over="ignore"):
        while True:
            if width & step:
                part = held[done : done + n]
                total = part.copy() if total is None else total * np.uint64(pow(_ODD, step, 1 << 64)) + part
                done += step
            if done == width:
                break
            held = held[:-step] * np.uint64(pow(_ODD, step, 1 << 64)) + held[step:]
            step *= 2
        total += np.uint64(width)
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        total = (total ^ (total >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return total ^ (total >> np.uint64(33))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and where each text begins and the last one ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def blocks_of(passages: DataFrame, pid: str, text: str) -> DataFrame:
    """``__pid, width, at, n_blocks, key``: the blocks of each passage and where they stand in it."""
    rows = passages.select(F.col(pid).alias("__pid"), F.col(text).alias("__p")).filter(F.length("__p") > 0)
    schema = T.StructType([rows.schema["__pid"], *[T.StructField(c, T.LongType()) for c in ("width", "at", "n_blocks", "key")]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for name, passage in zip(frame["__pid"], frame["__p"], strict=True):
                points, _ = code_points([passage])
                width = min(WINDOW, len(points))
                at = np.unique(np.append(np.arange(0, len(points) - width + 1, width), len(points) - width))
                parts.append(pd.DataFrame({"__pid": name, "width": width, "at": at, "n_blocks": len(at), "key": window_hashes(points, width)[at].view(np.int64)}))
            if parts:
                yield plain(pd.concat(parts, ignore_index=True))

    return rows.mapInPandas(run, schema)


def known_bits(blocks: DataFrame, size: int) -> np.ndarray:
    """The blocks' hashes as a table of ``size`` bits; at most a row for each 64 of them reaches the driver."""
    slot = F.col("key").bitwiseAND(F.lit(size - 1))
    rows = blocks.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(key & {size - 1} & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()
    words = np.zeros(size // 64, np.uint64)
    words[[r["word"] for r in rows]] = np.array([r["mask"] for r in rows], np.int64).view(np.uint64)
    return words


def find_passages(docs: DataFrame, passages: DataFrame, doc: str, pid: str, carry: list[str], text: str = "text") -> DataFrame:
    """(document id, carried columns, passage id) for every passage contained verbatim in a document, once for each.

    Null texts hold nothing and empty passages stand nowhere. Blocks are compared by 64-bit hashes, all of a passage's at once.
    """
    blocks = materialize(blocks_of(passages, pid, text), "blocks")
    widths = sorted(r["width"] for r in blocks.select("width").distinct().collect())  # at most WINDOW
    count, size = blocks.count(), LEAST_BITS
    while size < min(MOST_BITS, BITS_EACH * count):
        size *= 2
    shared = docs.sparkSession.sparkContext.broadcast(known_bits(blocks, size))
    kept = [doc, *carry]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in ("__row", "width", "place", "key")]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for frame in frames:
            frame = frame[frame[text].notna()].reset_index(drop=True)
            sizes = frame[text].str.len().to_numpy()
            at = 0
            while at < len(frame):
                to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, "right")) + at)
                points, offsets = code_points(frame[text].iloc[at:to].tolist())
                for width in widths:
                    hashes = window_hashes(points, width)
                    slot = hashes & np.uint64(size - 1)
                    hit = np.flatnonzero((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(offsets, hit, "right") - 1
                    inside = hit + width <= offsets[row + 1]
                    hit, row = hit[inside], row[inside]
                    if len(hit):
                        out = frame[[*kept, "__row"]].iloc[row + at].reset_index(drop=True)
                        yield plain(out.assign(width=width, place=hit - offsets[row], key=hashes[hit].view(np.int64)))
                at = to

    source = docs.select(*kept, text, F.monotonically_increasing_id().alias("__row"))
    found = source.mapInPandas(run, schema).join(blocks, ["width", "key"])
    whole = found.groupBy(*kept, "__row", "__pid", "n_blocks", (F.col("place") - F.col("at")).alias("start")).agg(F.count("*").alias("n"))
    return whole.filter("n = n_blocks").select(*kept, F.col("__pid").alias(pid), "__row").distinct().drop("__row")
