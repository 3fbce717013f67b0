"""64-bit hashes of words and shingles, a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C55)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 18
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: anything but ASCII white space, or letters and bytes beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]), dtype=np.uint64)
            _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, UNBASE)]), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole number (one to one)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null rows are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count:
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        if (sizes != np.diff(offsets)).any():  # bytes under a null are allowed; leave them out
            data = np.concatenate([data[:0], *[data[a : a + n] for a, n in zip(offsets[:-1], sizes, strict=True)]])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order (A-Z lower-cased), each row's offsets among them, and each word's length in bytes."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | first[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        at, block = starts[i], LOWER[data[starts[i] : ends[j - 1]]].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(block) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(block * up[:-1], dtype=np.uint64)])
            hashes[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * down[starts[i:j] - at]
        i = j
    return mixed(hashes), np.searchsorted(starts, offsets), ends - starts


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes, whatever texts they belong to."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(0x3C6EF372FE94F82B) * np.uint64(width))
        for j in range(width):
            total = (total + words[j : n + j]) * BASE
    return mixed(total)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; of the whole sequence if it is shorter; none without words."""
    return rolled(hashes, min(width, len(hashes))) if len(hashes) else hashes


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``shingles`` of each text (offsets ``rows`` into the words), sorted, one text after the other, and their numbers."""
    n, first = np.diff(rows), rows[:-1]
    out = np.zeros(len(hashes), np.uint64)
    whole = rolled(hashes, width)
    out[: len(whole)] = whole
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        out[first[i]] = rolled(hashes[first[i] : first[i] + n[i]], int(n[i]))[0]
    for a, c in zip(first[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
        out[a : a + c].sort()
    steps = np.zeros(len(hashes) + 1, np.int32)  # each text's shingles stand at its first words
    np.add.at(steps, first[counts > 0], 1)
    np.add.at(steps, (first + counts)[counts > 0], -1)
    keep = np.cumsum(steps[:-1]) > 0
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[first[counts > 0]] = True
    keep &= fresh
    held = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], held[rows[1:]] - held[first]


def grams(points: np.ndarray, width: int) -> np.ndarray:
    """32-bit hashes of all runs of ``width`` code points; the ones that cross a boundary are the caller's to leave out.

    A polynomial of the spread code points, put together from runs of half the length, then mixed.
    """
    n = len(points) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total, held, step = None, points * np.uint32(0x9E3779B1), 1  # hashes of runs of ``step``
    done = 0
    while True:
        if width & step:
            part = held[done : done + n]
            total = part.copy() if total is None else total * np.uint32(pow(0x01000193, step, 1 << 32)) + part
            done += step
        if done == width:
            break
        held = held[:-step] * np.uint32(pow(0x01000193, step, 1 << 32)) + held[step:]
        step *= 2
    total ^= total >> np.uint32(16)
    total *= np.uint32(0x85EBCA6B)
    total ^= total >> np.uint32(13)
    total *= np.uint32(0xC2B2AE35)
    total ^= total >> np.uint32(16)
    return total
