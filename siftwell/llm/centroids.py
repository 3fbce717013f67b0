"""Centroid clustering with a progressive search on Walsh-Hadamard coefficients.

Vectors become whole numbers and are transformed once; the transform of 64 numbers keeps 64 times every squared distance,
so sums over some of the coefficients never exceed it. A vector adds up its differences to all centroids from coarse
coefficients (few changes of sign) to fine ones. The centroid that leads after the first ones is finished at once; others
go as soon as their sums exceed its distance, and those that are left finish all 64. Everything is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, forget
from siftwell.session import local_table

DIM = 64
#: Scaled components stay below this, so that 64 times a squared distance and the sums on the way to it fit in 64 bits.
LIMIT = 1 << 24
#: Coefficients after which centroids are dropped.
STEPS = (4, 8, 16, 32, DIM)


@dataclass(frozen=True)
class Clustering:
    centroids: int = 8
    rounds: int = 10
    scale: int = 1024
    seed: int = 3


def coarse_to_fine() -> np.ndarray:
    """Rows of the Hadamard matrix (bitwise order) by their number of changes of sign."""
    i = np.arange(DIM)
    signs = np.array([[bin(a & b).count("1") & 1 for b in i] for a in i])
    return np.argsort(np.abs(np.diff(signs, axis=1)).sum(axis=1), kind="stable")


ORDER = coarse_to_fine()


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row of whole numbers, unscaled, coarse coefficients first."""
    out = x.astype(np.int64)
    h = 1
    while h < DIM:
        pairs = out.reshape(len(out), DIM // (2 * h), 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), DIM)
        h *= 2
    return out[:, ORDER]


def restored(coefficients: list[int]) -> list[int]:
    """The numbers whose transform these are, in Python's whole numbers: sums over any number of vectors stay exact."""
    out = [0] * DIM
    for place, value in zip(ORDER.tolist(), coefficients, strict=True):
        out[place] = value
    h = 1
    while h < DIM:
        for i in range(0, DIM, 2 * h):
            for j in range(i, i + h):
                out[j], out[j + h] = out[j] + out[j + h], out[j] - out[j + h]
        h *= 2
    return [v // DIM for v in out]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and 64 times the squared distance; both transformed."""
    n, k = len(vectors), len(centroids)
    first = STEPS[0]
    sums = ((vectors[:, None, :first] - centroids[None, :, :first]) ** 2).sum(axis=2)
    leader = sums.argmin(axis=1)
    bound = sums[np.arange(n), leader] + ((vectors[:, first:] - centroids[leader, first:]) ** 2).sum(axis=1)
    alive = sums <= bound[:, None]
    alive[np.arange(n), leader] = False  # finished already
    row, c = np.nonzero(alive)
    part = sums[row, c]
    for a, b in zip(STEPS, STEPS[1:], strict=False):
        part = part + ((vectors[row, a:b] - centroids[c, a:b]) ** 2).sum(axis=1)
        left = part <= bound[row]
        row, c, part = row[left], c[left], part[left]
    full = np.full((n, k), np.iinfo(np.int64).max)
    full[np.arange(n), leader] = bound
    full[row, c] = part
    best = full.argmin(axis=1)
    return best, full[np.arange(n), best]


def usable(vector: Column, plan: Clustering) -> Column:
    """Exactly 64 finite components whose scaled values are below ``LIMIT``."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / plan.scale))
    return F.coalesce((F.size(vector) == DIM) & fine, F.lit(False))


def coded(vectors: DataFrame, plan: Clustering) -> DataFrame:
    """``vec_id, place`` (its rank key as a centroid) and ``c``: the transformed numbers as 64 32-bit integers."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v")).filter(usable(F.col("v"), plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), DIM)
            coefficients = transformed(np.floor(x * plan.scale)).astype("<i4")
            blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DIM), len(x), [None, pa.py_buffer(np.ascontiguousarray(coefficients))])
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs.cast(pa.binary())], names=["vec_id", "c"])

    return rows.mapInArrow(run, "vec_id long, c binary")


def blobs_of(column: pa.Array) -> np.ndarray:
    """Coefficients of a batch, one row per vector."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i4", count=(offsets[-1] - offsets[0]) // 4, offset=int(offsets[0])).reshape(-1, DIM).astype(np.int64)


def moved(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of coefficients of each centroid's vectors: one row per centroid and coefficient reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, DIM), np.int64)
        for batch in batches:
            if len(batch):
                x = blobs_of(batch.column(0))
                best, _ = nearest(x, centroids)
                counts += np.bincount(best, minlength=k)
                for c in np.unique(best).tolist():
                    sums[c] += x[best == c].sum(axis=0)
        full = np.flatnonzero(counts)
        names = [pa.array(np.repeat(full, DIM + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, DIM, dtype=np.int32), len(full))), pa.array(np.concatenate([counts[full, None], sums[full]], axis=1).ravel())]
        yield pa.RecordBatch.from_arrays(names, names=["cluster", "i", "s"])

    # A task's sums fit in 64 bits (fewer than 2^32 vectors); those of all tasks may not.
    parts = table.select("c").mapInArrow(run, "cluster int, i int, s long")
    rows = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in rows:
        found.setdefault(r["cluster"], {})[r["i"]] = int(r["s"])
    return {c: (by[-1], [by[i] for i in range(DIM)]) for c, by in found.items()}


def cluster(vectors: DataFrame, plan: Clustering = Clustering()) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding): ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    A row is usable with exactly 64 components, none null, NaN or infinite, and none that scaled reaches 2^24 (distances
    in 64 bits would not be safe beyond); other rows are left out. Components become floor(scale * x). The first centroids
    are the vectors with the smallest SHA-256 of ``seed:vec_id``, fewer if there are fewer rows; rows with one id are
    rows of their own (ordered by their components) and rows without an id are clustered but never start as a centroid, unless all are such.
    Each round moves every centroid that has vectors to the floor of their mean. Inertias beyond 64 bits are null.
    """
    spark = vectors.sparkSession
    table = cut(coded(vectors, plan))
    name = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("vec_id").cast("string")), 256)
    starts = table.select(name.alias("name"), "c").orderBy(F.col("name").asc_nulls_last(), "c").limit(plan.centroids).collect()
    points = [restored(np.frombuffer(r["c"], "<i4").tolist()) for r in starts]
    for _ in range(plan.rounds if points else 0):
        for c, (n, sums) in moved(table, transformed(np.array(points))).items():
            points[c] = [s // n for s in restored(sums)]
    centres = transformed(np.array(points)) if points else np.zeros((0, DIM), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                best, distance = nearest(blobs_of(batch.column(1)), centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance // DIM)], names=["vec_id", "cluster", "distance"])

    found = cut(table.select("vec_id", "c").mapInArrow(run, "vec_id long, cluster int, distance long"))
    forget(table)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    kept = lambda n: n if n < 1 << 63 else None
    facts = [(c, kept(s), kept(sum(sums.values())), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for c, s in sorted(sums.items())]
    table_of = local_table(spark, facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(table_of), "cluster")  # one row per centroid
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
