"""Near copies among embeddings by int8 tile products with rigorous error bounds.

Vectors of one label and dimension are cut into tiles, and every pair of tiles of a label is one piece of work. A unit
vector u is kept as a scale times int8 numbers, u = s q + r, with e = |r|. For two of them the true cosine differs from
s s' (q . q') by at most |s q| e' + e |s' q'| + e e'. Tiles travel as int8 numbers with a scale and an error per vector. Pairs
whose upper bound lies below the threshold are passed by; the vectors of the others, and no more, follow in double
precision to the same pair of tiles, where those pairs are computed anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut
from siftwell.llm.components import components

#: Products of int8 numbers add up exactly in single precision for so many of them.
EXACT = 1024
#: Beyond rounding in the bounds themselves.
SLACK = 1e-9


@dataclass(frozen=True)
class Tiling:
    threshold: float = 0.98
    #: Vectors of a tile on average.
    tile: int = 512


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of the coded vectors and of the errors."""
    scales = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scales[:, None]).astype(np.int8)
    coded = codes * scales[:, None]
    return codes, scales, np.linalg.norm(coded, axis=1), np.linalg.norm(units - coded, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two tiles of codes."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


@dataclass
class Codes:
    """A tile as it travels: row numbers, int8 codes, scales, norms of the coded vectors and of the errors."""

    rows: np.ndarray
    codes: np.ndarray
    facts: np.ndarray

    @staticmethod
    def of(rows: bytes, codes: bytes, facts: bytes) -> Codes:
        ids = np.frombuffer(rows, np.int64)
        return Codes(ids, np.frombuffer(codes, np.int8).reshape(len(ids), -1), np.frombuffer(facts, np.float64).reshape(3, -1))


def possible(a: Codes, b: Codes, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose cosine may reach the threshold; within one tile each pair once."""
    (sa, na, ea), (sb, nb, eb) = a.facts, b.facts
    upper = products(a.codes, b.codes) * sa[:, None] * sb + (na[:, None] * eb + ea[:, None] * nb + ea[:, None] * eb)
    near = upper >= threshold - SLACK
    return np.nonzero(np.triu(near, 1) if same else near)


def reached(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold in double precision."""
    norms_a, norms_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        keep[at : at + (1 << 14)] = np.einsum("ij,ij->i", a[x], b[y]) / (norms_a[x] * norms_b[y]) >= threshold
    return keep


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given ones connect, one less than members per component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


TILE = "label long, dim int, tile int, tiles int, rows binary, codes binary, facts binary, data binary"


def packed(vectors: DataFrame, plan: Tiling) -> DataFrame:
    """One row per tile (TILE): the rows' numbers, codes with their facts, and the vectors as doubles.

    Tiles are drawn by the hash of the row number; their count per label and dimension follows from the rows.
    """
    counts = vectors.groupBy("label", "dim").agg(F.ceil(F.count("*") / plan.tile).cast("int").alias("tiles"))
    placed = vectors.join(cut(counts), ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        data = np.array(frame["v"].tolist(), np.float64)
        codes, *facts = quantised(data / np.linalg.norm(data, axis=1)[:, None])
        first = frame.iloc[0]
        blobs = {"rows": frame["rid"].to_numpy(np.int64), "codes": codes, "facts": np.array(facts), "data": data}
        return pd.DataFrame({**{c: [first[c]] for c in ("label", "dim", "tile", "tiles")}, **{c: [x.tobytes()] for c, x in blobs.items()}})

    return placed.groupBy("label", "dim", "tile").applyInPandas(pack, TILE)


def asked_rows(tiles: DataFrame, plan: Tiling) -> DataFrame:
    """``label, dim, low, high, tile, rows``: for each pair of tiles with pairs that may link, the rows of either tile that are in one."""
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    work = tiles.select("label", "dim", "tile", "rows", "codes", "facts", other)
    work = work.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tile")
        first, same = frame.iloc[0], frame.iloc[0]["low"] == frame.iloc[0]["high"]
        held = [Codes.of(*x) for x in zip(frame["rows"], frame["codes"], frame["facts"], strict=True)]
        i, j = possible(held[0], held[-1], plan.threshold, same) if same or len(held) == 2 else ([], [])
        if not len(i):  # nothing near, or the other tile got no rows
            return pd.DataFrame({"label": [], "dim": [], "low": [], "high": [], "tile": [], "rows": []})
        sides = {int(first["low"]): np.union1d(i, j) if same else np.unique(i)} | ({} if same else {int(first["high"]): np.unique(j)})
        out = [(first["label"], first["dim"], first["low"], first["high"], t, at.astype(np.int32).tobytes()) for t, at in sides.items()]
        return pd.DataFrame(out, columns=["label", "dim", "low", "high", "tile", "rows"])

    return work.groupBy("label", "dim", "low", "high").applyInPandas(compare, "label long, dim int, low int, high int, tile int, rows binary")


def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each asked tile (label, dim, low, high, tile, asked, rows, codes, facts, data) the asked rows."""
    for batch in batches:
        out = []
        for label, dim, low, high, tile, asked, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = np.frombuffer(asked, np.int32)
            held = Codes.of(*blobs[:3])
            data = np.frombuffer(blobs[3], np.float64).reshape(-1, dim)
            out.append((label, dim, low, high, tile, held.rows[at].tobytes(), held.codes[at].tobytes(), np.ascontiguousarray(held.facts[:, at]).tobytes(), data[at].tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = ["label", "dim", "low", "high", "tile", "rows", "codes", "facts", "data"]
        columns = list(zip(*out, strict=True)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def near_vectors(vectors: DataFrame, plan: Tiling = Tiling()) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, label, embedding): ``vec_id, n_links, component_id, kept``.

    Rows link when label and dimension are equal, the label isn't null, and the cosine in double precision reaches the
    threshold. A null, empty or zero vector, or one with null or non-finite numbers, links with nothing. ``n_links`` counts
    linked rows, ``component_id`` is the smallest vec_id reachable and ``kept`` whether it is the row's own. A null vec_id
    links with nothing. Rows with one vec_id are rows of their own that count each other if they link.
    A tile pair gives counts and a spanning forest, so a dense group costs no row per pair after the tasks.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), vectors["vec_id"], vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("v"))
    rows = cut(rows)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(fine)
    # Scaled by a power of two, so that squares neither overflow nor vanish.
    scaled = F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs))))))
    tiles = cut(packed(usable.select("rid", "label", F.size("v").alias("dim"), scaled.alias("v")), plan))
    keys = ["label", "dim", "tile"]
    asked = cut(asked_rows(tiles, plan)).select("label", "dim", "low", "high", "tile", F.col("rows").alias("asked"))
    near = asked.join(tiles.select(*keys, "rows", "codes", "facts", "data"), keys).select("label", "dim", "low", "high", "tile", "asked", "rows", "codes", "facts", "data")
    near = near.mapInArrow(picked, "label long, dim int, low int, high int, tile int, rows binary, codes binary, facts binary, data binary")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tile")
        dim, same = int(frame.iloc[0]["dim"]), len(frame) == 1
        held = [Codes.of(*x) for x in zip(frame["rows"], frame["codes"], frame["facts"], strict=True)]
        data = [np.frombuffer(d, np.float64).reshape(-1, dim) for d in frame["data"]]
        i, j = possible(held[0], held[-1], plan.threshold, same)
        keep = reached(data[0], data[-1], i, j, plan.threshold)
        x, y = held[0].rows[i[keep]], held[-1].rows[j[keep]]
        edges = forest(x, y)
        who, n = np.unique(np.concatenate([x, y]), return_counts=True)
        return pd.DataFrame({"rid": [*who.tolist(), *(e[0] for e in edges)], "other": [*who.tolist(), *(e[1] for e in edges)], "n": [*n.tolist(), *([0] * len(edges))]}, dtype="int64")

    found = cut(near.groupBy("label", "dim", "low", "high").applyInPandas(compare, "rid long, other long, n long"))
    counts = found.filter("n > 0").groupBy("rid").agg(F.sum("n").alias("n_links"))
    groups = components(found.filter("n = 0"), "rid", "other")
    out = rows.select("rid", "vec_id").join(counts, "rid", "left").join(groups.withColumnRenamed("id", "rid"), "rid", "left")
    out = cut(out.select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "rid").alias("group")))
    # Row numbers stand for the groups; each takes the name of its smallest id.
    names = cut(out.filter("n_links > 0").groupBy("group").agg(F.min("vec_id").alias("name")))
    named = out.join(names, "group", "left").select("vec_id", "n_links", F.coalesce("name", "vec_id").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
