"""Nearest-neighbour search of many queries against a large vector table.

Exact search compares every query with every vector, but never as joined rows: vectors stay where they were
read, each task scores its Arrow batches against a matrix of queries and emits its best k per query only. A query
set that is too large to ship to every task is cut with the vectors into a grid of bounded cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.frames import empty, plain
from siftwell.operators.embed import Embedder, embed

# Bytes of query vectors that may be shipped to every task; larger sets take the grid.
MAX_SHIPPED_BYTES = 64 << 20
# Rows of one side of a grid cell, and cells for each core.
CELL_QUERIES, CELL_VECTORS, CELLS_PER_CORE = 40_000, 100_000, 3
# Bytes that a task keeps for each of a query's best k.
HIT_BYTES = 32
# Vectors and scores that a task handles at a time, hits after which it merges, and rows that it hands on at a time.
SLICE, STRIP, MERGE_AT, SENT = 4096, 2_000_000, 250_000, 50_000
DECIMALS = 6


@dataclass(frozen=True)
class Spec:
    qid: str
    vid: str
    k: int
    metric: str
    match: tuple[str, ...]
    exclude_self: bool


def _matrix(values: pd.Series, dim: int | None = None) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in values]
    if not rows:
        return np.zeros((0, dim or 0))
    return np.vstack(rows)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _same_size(frame: pd.DataFrame, column: str, dim: int) -> pd.DataFrame:
    ok = frame[column].map(lambda v: v is not None and len(v) == dim)
    return frame if ok.all() else frame[ok]


class _Queries:
    """Query vectors and match columns as arrays."""

    def __init__(self, frame: pd.DataFrame, spec: Spec, dim: int):
        frame = _same_size(frame, "__qv", dim).reset_index(drop=True)
        self.dim = dim
        self.ids = frame["__qid"].to_numpy()
        self.matrix = _matrix(frame["__qv"], self.dim)
        if spec.metric == "cosine":
            self.matrix = _unit(self.matrix)
        #: By which match columns a query states, and their values: its rows.
        self.stated: dict[tuple[int, ...], dict[tuple, list[int]]] = {}
        columns = [frame[f"__q_{m}"].tolist() for m in spec.match]
        for row in range(len(frame)):
            values = [c[row] for c in columns]
            stated = tuple(i for i, w in enumerate(values) if w is not None and w == w)
            self.stated.setdefault(stated, {}).setdefault(tuple(values[i] for i in stated), []).append(row)


def _meetings(queries: _Queries, frame: pd.DataFrame, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query rows and the vector rows that they may see. A query stands in one of them; vectors that no query may see stand in none."""
    for stated, by_value in queries.stated.items():
        if not stated:
            yield np.asarray(by_value[()]), np.arange(len(frame))
            continue
        for value, rows in frame.groupby([f"__v_{spec.match[i]}" for i in stated], sort=False).indices.items():
            value = value if isinstance(value, tuple) else (value,)
            if value in by_value:
                yield np.asarray(by_value[value]), rows


def _by_size(frame: pd.DataFrame, spec: Spec) -> list[_Queries]:
    """Queries of each vector length apart: a query sees vectors of its own length only."""
    return [_Queries(frame, spec, dim) for dim in sorted({len(v) for v in frame["__qv"] if v is not None and len(v)})]


class _Best:
    """The best k vectors that each query has met so far, ties to the smaller id: k rows of ids and scores for each query, whatever the number of vectors."""

    def __init__(self, queries: _Queries, spec: Spec, payload: Sequence[str]):
        self.queries, self.spec, self.names = queries, spec, ["__vid", *payload]
        self.rows, self.scores, self.columns = np.zeros(0, np.int64), np.zeros(0), []
        #: What a vector must score to be among a query's best k.
        self.least = np.full(len(queries.ids), -np.inf)
        self.new: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        self.n_new = 0

    def meet(self, frame: pd.DataFrame, asked: np.ndarray | None = None) -> None:
        """Score the vectors of ``frame`` against the query rows ``asked``, or against those whose match columns let them see a vector."""
        frame = _same_size(frame, "__vv", self.queries.dim)
        for lo in range(0, len(frame) if len(self.queries.ids) else 0, SLICE):
            part = frame.iloc[lo : lo + SLICE].reset_index(drop=True)
            vectors = _matrix(part["__vv"], self.queries.dim)
            if self.spec.metric == "cosine":
                vectors = _unit(vectors)
            columns = [part[c].to_numpy() for c in self.names]
            meetings = [(asked, np.arange(len(part)))] if asked is not None else _meetings(self.queries, part, self.spec)
            for mine, seen in meetings:
                # Query rows are scored in strips, so the score matrix stays small whatever the query count.
                strip = max(1, STRIP // len(seen))
                for at in range(0, len(mine), strip):
                    self._strip(mine[at : at + strip], vectors[seen], [c[seen] for c in columns])

    def _strip(self, mine: np.ndarray, vectors: np.ndarray, columns: list[np.ndarray]) -> None:
        scores = self.queries.matrix[mine] @ vectors.T
        if np.isnan(scores.sum()):
            scores[np.isnan(scores)] = -np.inf
        least, own = self.least[mine], int(self.spec.exclude_self)
        fresh = np.flatnonzero(least == -np.inf)
        if len(fresh):
            place = scores.shape[1] - min(self.spec.k + own, scores.shape[1])
            least[fresh] = np.partition(scores[fresh], place, axis=1)[:, place]
        # What rounding may lift to the bound counts, too: ties of rounded scores go by id.
        rows, cols = np.nonzero(scores >= (least - 10.0**-DECIMALS)[:, None])
        value = np.round(scores[rows, cols], DECIMALS) + 0.0
        ok = value > -np.inf
        if own:
            ok &= self.queries.ids[mine[rows]] != columns[0][cols]
        rows, cols, value = mine[rows[ok]], cols[ok], value[ok]
        self.new.append((rows, value, [c[cols] for c in columns]))
        self.n_new += len(rows)
        if self.n_new >= MERGE_AT:
            self.merge()

    def merge(self) -> None:
        """Take the new hits into the best k."""
        if not self.n_new:
            return
        parts = [(self.rows, self.scores, self.columns)] * bool(len(self.rows)) + self.new
        rows, scores = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        columns = [np.concatenate([p[2][i] for p in parts]) for i in range(len(self.names))]
        ids = columns[0] if columns[0].dtype != object else np.unique(columns[0], return_inverse=True)[1]
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        order, rows = order[place < self.spec.k], rows[place < self.spec.k]
        self.rows, self.scores, self.columns = rows, scores[order], [c[order] for c in columns]
        full = np.flatnonzero(place[place < self.spec.k] == self.spec.k - 1)
        self.least[rows[full]] = self.scores[full]
        self.new, self.n_new = [], 0

    def frames(self) -> Iterator[pd.DataFrame]:
        """The best k of all queries, in pieces."""
        self.merge()
        for lo in range(0, len(self.rows), SENT):
            cut = slice(lo, lo + SENT)
            out = {self.spec.qid: self.queries.ids[self.rows[cut]], self.spec.vid: self.columns[0][cut], "score": self.scores[cut]}
            yield plain(pd.DataFrame(out | {n: c[cut] for n, c in zip(self.names[1:], self.columns[1:], strict=True)}))


def _all_best(queries: pd.DataFrame, spec: Spec, payload: Sequence[str]) -> list[_Best]:
    return [_Best(q, spec, payload) for q in _by_size(queries, spec)]


def _together(best: Sequence[_Best], names: list[str]) -> pd.DataFrame:
    found = [f for b in best for f in b.frames()]
    return pd.concat(found, ignore_index=True) if found else empty(names)


def _sides(queries: DataFrame, index: DataFrame, spec: Spec, qvec: str, vvec: str, payload: Sequence[str], stored: bool):
    q = queries.select(
        F.col(spec.qid).alias("__qid"), F.col(qvec).alias("__qv"), *[F.col(m).alias(f"__q_{m}") for m in spec.match]
    ).filter(F.size("__qv") > 0)
    v = index.select(
        F.col(spec.vid).alias("__vid"),
        F.col(vvec).alias("__vv"),
        *[F.col(m).alias(f"__v_{m}") for m in spec.match],
        *payload,
    ).filter(F.size("__vv") > 0 if stored else F.col("__vv").isNotNull())
    return q, v


def _out_schema(queries: DataFrame, index: DataFrame, spec: Spec, payload: Sequence[str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField(spec.qid, queries.schema[spec.qid].dataType),
            T.StructField(spec.vid, index.schema[spec.vid].dataType),
            T.StructField("score", T.DoubleType()),
            *[T.StructField(c, index.schema[c].dataType) for c in payload],
        ]
    )


def _ranked(scored: DataFrame, spec: Spec, sources: int = 1) -> DataFrame:
    """Best k per query of what ``sources`` tasks have found, merged in two levels: no task gets more than about sqrt(sources) lists of one query."""
    groups = max(1, round(sources**0.5))
    order = (F.col("score").desc(), F.col(spec.vid))
    part = Window.partitionBy(spec.qid, "__part").orderBy(*order)
    some = scored.withColumn("__part", F.pmod(F.xxhash64(spec.vid), F.lit(groups)))
    some = some.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= spec.k).drop("rank", "__part") if groups > 1 else scored
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(spec.qid).orderBy(*order))).filter(F.col("rank") <= spec.k)


def knn(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    *,
    qid: str = "qid",
    vid: str = "vec_id",
    qvec: str = "embedding",
    vvec: str = "embedding",
    metric: str = "cosine",
    match: Sequence[str] = (),
    payload: Sequence[str] = (),
    exclude_self: bool = False,
    max_shipped_bytes: int = MAX_SHIPPED_BYTES,
    embedder: Embedder | None = None,
) -> DataFrame:
    """Exact top ``k`` per query by cosine or inner product (``ip``), rounded to six digits, ties by ``vid``.

    ``match`` names columns both sides hold: a query only sees vectors equal on them, a NULL in the query means
    no constraint. ``payload`` columns of the index are carried along. Filter the index before calling. With an
    ``embedder``, ``vvec`` names a text column that is embedded where it is scored, so vectors need not be stored.
    """
    spec = Spec(qid, vid, k, metric, tuple(match), exclude_self)
    q, v = _sides(queries, index, spec, qvec, vvec, payload, embedder is None)
    size = q.agg(
        F.count("*").alias("n"),
        F.sum(F.size("__qv") * 8 + F.lit(64 * (1 + len(match)) + HIT_BYTES * k)).alias("bytes"),
    ).first()
    schema = _out_schema(queries, index, spec, payload)
    if (size["bytes"] or 0) > max_shipped_bytes:
        if embedder is not None:
            v = embed(v, embedder, "__vv", "__e").drop("__vv").withColumnRenamed("__e", "__vv")
        height = block_rows(size["n"], v.count(), q.sparkSession.sparkContext.defaultParallelism)
        return knn_grid(q.withColumn("__cell", F.lit(0)), v.withColumn("__cell", F.lit(0)), spec, schema, payload, cell_vectors=height)
    shipped = q.sparkSession.sparkContext.broadcast(q.toPandas())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _all_best(shipped.value, spec, payload)
        for frame in frames:
            if embedder is not None:
                frame["__vv"] = list(embedder(frame["__vv"]))
            for part in best:
                part.meet(frame)
        for part in best:
            yield from part.frames()

    return _ranked(v.mapInPandas(run, schema), spec, v._jdf.queryExecution().toRdd().getNumPartitions())


def block_rows(n_queries: int, n_vectors: int, cores: int) -> int:
    """Vectors of a grid cell: few enough that the cells keep all cores busy, and never more than ``CELL_VECTORS``."""
    blocks = -(-CELLS_PER_CORE * cores // max(1, -(-n_queries // CELL_QUERIES)))
    return max(1, min(CELL_VECTORS, -(-n_vectors // blocks)))


def knn_grid(
    q: DataFrame, v: DataFrame, spec: Spec, schema: T.StructType, payload: Sequence[str],
    cell_queries: int = CELL_QUERIES, cell_vectors: int = CELL_VECTORS,
) -> DataFrame:
    """Top k per query over pairs that share ``__cell``, with bounded work per task.

    Each cell is cut into query blocks and vector blocks by hashes of the unique ids, as many as its row counts
    ask for, and every (query block, vector block) meets once. A cell holding a third of the table is just
    more blocks. Tasks emit k rows per query.
    """
    nq = q.groupBy("__cell").agg(F.ceil(F.count("*") / F.lit(cell_queries)).cast("int").alias("__nq"))
    nv = v.groupBy("__cell").agg(F.ceil(F.count("*") / F.lit(cell_vectors)).cast("int").alias("__nv"))
    plan = nq.join(nv, "__cell")

    def block(id_col: str, n: str) -> Column:
        return F.pmod(F.xxhash64(F.col(id_col)), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = q.join(plan, "__cell").withColumn("__qb", block("__qid", "__nq")).withColumn("__vb", every("__nv"))
    right = v.join(plan, "__cell").withColumn("__vb", block("__vid", "__nv")).withColumn("__qb", every("__nq"))
    keys = ["__cell", "__qb", "__vb"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return empty(schema.names)
        best = _all_best(a, spec, payload)
        for part in best:
            part.meet(b)
        return _together(best, schema.names)

    scored = left.drop("__nq", "__nv").groupBy(*keys).cogroup(right.drop("__nq", "__nv").groupBy(*keys)).applyInPandas(run, schema)
    return _ranked(scored, spec)
