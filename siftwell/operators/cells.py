"""A stored index of vectors in cells: approximate search that reads only the folders of the cells a query probes.

Vectors lie in one folder per cell of a k-means clustering, about as many cells as the square root of the rows, with the
centres beside them. They are written once. A search ranks the centres per query, reads the folders of the probed
cells through partition pruning, and scores where the vectors lie: they are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.frames import empty
from siftwell.operators import knn as nn
from siftwell.session import materialize

#: More cells are never made, so that the centres stay small enough to be sent to every task.
MAX_CELLS = 16_384
#: Rows per cell that centres are fitted on, and queries that the number of probes is fitted on.
SAMPLE_PER_CELL, SAMPLE_QUERIES = 256, 256


@dataclass(frozen=True)
class Cells:
    """Where the index lies, its centres (a row for each cell), and how many cells a query probes."""

    path: str
    centres: np.ndarray
    probes: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def fit_cells(index: DataFrame, n_cells: int, vec: str = "embedding", seed: int = 7) -> np.ndarray:
    """K-means cell centres over unit vectors; only the centres (cells x dimensions) reach the driver."""
    ready = index.select(array_to_vector(F.col(vec).cast("array<double>")).alias("raw"))
    ready = Normalizer(inputCol="raw", outputCol="features").transform(ready)
    return np.vstack(KMeans(k=n_cells, seed=seed, maxIter=10).fit(ready).clusterCenters())


def nearest_cells(df: DataFrame, centres: np.ndarray, n: int, vec: str = "embedding") -> DataFrame:
    """Add ``cells``: the ``n`` cells whose centres are nearest to the unit vector, nearest first."""
    norms = (centres * centres).sum(axis=1)[None, :]

    @F.pandas_udf("array<int>")
    def pick(values: pd.Series) -> pd.Series:
        m = nn._unit(nn._matrix(values, centres.shape[1]))
        found: list[np.ndarray] = []
        step = max(1, nn.STRIP // len(centres))
        for lo in range(0, len(m), step):
            d = np.round(norms - 2 * m[lo : lo + step] @ centres.T, 9)
            found += list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32))
        return pd.Series(found)

    return df.withColumn("cells", pick(F.col(vec)))


def assigned(index: DataFrame, centres: np.ndarray, vec: str) -> DataFrame:
    return nearest_cells(index, centres, 1, vec).withColumn("cell", F.col("cells")[0]).drop("cells")


def split_cells(index: DataFrame, centres: np.ndarray, mean: float, overfull: float, vec: str, seed: int) -> np.ndarray:
    """The centres with each one of an overfull cell replaced by several, fitted on a bounded sample of the cell by one task per cell."""
    counts = {r["cell"]: r["n"] for r in assigned(index, centres, vec).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    full = {c: n for c, n in counts.items() if n > overfull * mean}
    room = MAX_CELLS - len(centres)
    if not full or room <= 0:
        return centres
    share = F.create_map(*[F.lit(x) for c, n in full.items() for x in (c, min(1.0, SAMPLE_PER_CELL * (n / mean) / n))])
    rows = assigned(index, centres, vec).filter(F.col("cell").isin(*full)).filter(F.rand(seed) < share[F.col("cell")])

    def refit(frame: pd.DataFrame) -> pd.DataFrame:
        m = nn._unit(nn._matrix(frame[vec]))
        cell = int(frame["cell"].iloc[0])
        rng = np.random.default_rng(seed + cell)
        own = np.unique(m, axis=0)
        own = own[rng.permutation(len(own))[: max(2, round(full[cell] / mean))]]
        for _ in range(10):
            near = ((own * own).sum(axis=1)[None, :] - 2 * m @ own.T).argmin(axis=1)
            own = np.vstack([m[near == c].mean(axis=0) if (near == c).any() else own[c] for c in range(len(own))])
        return pd.DataFrame({"cell": cell, "centre": list(own)})

    made = rows.select("cell", vec).groupBy("cell").applyInPandas(refit, "cell int, centre array<double>").toPandas()
    made = made[made.groupby("cell")["centre"].transform("size") > 1]  # equal vectors can't be told apart
    made = made.iloc[: room + made["cell"].nunique()]
    kept = [c for i, c in enumerate(centres) if i not in set(made["cell"])]
    return np.vstack([*kept, *made["centre"]])


def build_cells(
    index: DataFrame, path: str, vid: str = "vec_id", vec: str = "embedding", cells: int | None = None, overfull: float = 4.0,
    recall: float = 0.9, k: int = 10, rounds: int = 4, seed: int = 7,
) -> Cells:
    """Write ``index`` below ``path`` in cells and return the index. Rows whose vector is null, empty or of another length than the first are left out.

    Centres are fitted on at most ``SAMPLE_PER_CELL`` rows for each cell; cells with more than ``overfull`` times
    the mean are split, up to ``rounds`` times. The number of probes is the smallest that finds a share ``recall`` of the true ``k``
    neighbours of at most ``SAMPLE_QUERIES`` rows. Every row is indexed.
    """
    spark = index.sparkSession
    first = index.filter(F.size(vec) > 0).select(F.size(vec).alias("d")).first()
    usable = index.filter(F.size(vec) == (first["d"] if first else 0))
    n = usable.count()
    if not n:
        raise ValueError("an index of cells needs a vector")
    want = min(MAX_CELLS, cells or max(1, round(n**0.5)))
    train = usable.sample(min(1.0, 1.2 * SAMPLE_PER_CELL * want / n), seed=seed)
    centres = fit_cells(train, want, vec, seed)
    for _ in range(rounds):
        more = split_cells(usable, centres, n / want, overfull, vec, seed)
        if len(more) == len(centres):
            break
        centres = more
    rows = assigned(usable, centres, vec)
    # Gathered by cell, so that tasks don't each write a file per cell; the rebalance splits a large cell over several tasks.
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = Cells(path, centres, len(centres))
    probes = probes_for(stored, spark, vid, vec, recall, k, n, seed)
    table = pd.DataFrame({"cell": range(len(centres)), "centre": centres.tolist(), "probes": probes})
    spark.createDataFrame(table, "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return Cells(path, centres, probes)


def probes_for(index: Cells, spark: SparkSession, vid: str, vec: str, recall: float, k: int, n: int, seed: int) -> int:
    """How many cells hold a share ``recall`` of the true neighbours of sampled rows, nearest cells first."""
    rows = index.vectors(spark)
    asked = rows.sample(min(1.0, 1.2 * SAMPLE_QUERIES / n), seed=seed).limit(SAMPLE_QUERIES).select(F.col(vid).alias("qid"), F.col(vec).alias("embedding"))
    asked = materialize(asked, "sampled")
    near = nn.knn(asked, rows, k, vid=vid, vvec=vec, payload=["cell"], exclude_self=True)
    ranked = nearest_cells(asked, index.centres, len(index.centres)).select("qid", "cells")
    at = near.join(ranked, "qid").groupBy(F.array_position("cells", F.col("cell")).alias("at")).agg(F.count("*").alias("n"))
    found = sorted((r["at"], r["n"]) for r in at.collect())  # a row for each cell at most
    total, held = sum(c for _, c in found), 0
    for place, count in found:
        held += count
        if held >= recall * total:
            return int(place)
    return len(index.centres)


def open_cells(spark: SparkSession, path: str) -> Cells:
    """A stored index; its centres are read, not fitted."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return Cells(path, np.array([r["centre"] for r in rows]), rows[0]["probes"])


def search_cells(
    queries: DataFrame, index: Cells, k: int, probes: int | None = None, *, qid: str = "qid", vid: str = "vec_id", vec: str = "embedding",
    exclude_self: bool = False, payload: Sequence[str] = (), max_shipped_bytes: int = nn.MAX_SHIPPED_BYTES,
) -> DataFrame:
    """Top ``k`` by cosine per query (``qid, embedding``) among the vectors of its ``probes`` nearest cells.

    A query set of bounded size (with its lists of cells) goes to the tasks, which read the folders of the cells that it probes. A larger one is cut
    into blocks, and the cells into runs of bounded size: a block meets a run in one task, with each query's cells of that run only.
    """
    spark = queries.sparkSession
    spec = nn.Spec(qid, vid, k, "cosine", (), exclude_self)
    table = index.vectors(spark)
    schema = nn._out_schema(queries, table, spec, payload)
    dim, n_probes = index.centres.shape[1], min(probes or index.probes, len(index.centres))
    asked = nearest_cells(queries.filter(F.size("embedding") == dim), index.centres, n_probes)
    asked = materialize(asked.select(F.col(qid).alias("__qid"), F.col("embedding").alias("__qv"), "cells"), "probes")
    n = asked.count()
    if n * (8 * dim + 64 + 8 * n_probes + nn.HIT_BYTES * k) <= max_shipped_bytes:
        found = _search_block(asked.toPandas(), table, spec, schema, vec, payload)
        return nn._ranked(found, spec, found._jdf.queryExecution().toRdd().getNumPartitions())
    return _search_grid(asked, n, _scored_columns(table, spec, vec, payload), spec, schema, payload)


def _scored_columns(table: DataFrame, spec: nn.Spec, vec: str, payload: Sequence[str]) -> DataFrame:
    return table.select("cell", F.col(spec.vid).alias("__vid"), F.col(vec).alias("__vv"), *payload)


def _rows_by_cell(cells: pd.Series) -> dict[int, np.ndarray]:
    """Which query rows probe a cell."""
    flat = np.concatenate([np.zeros(0, np.int32), *cells]).astype(np.int64)
    rows = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows[order], starts[1:]), strict=True)) if len(names) else {}


def _meet_cells(best: nn._Best, by_cell: dict[int, np.ndarray], frame: pd.DataFrame) -> None:
    for cell, part in frame.groupby("cell"):
        if int(cell) in by_cell:
            best.meet(part, by_cell[int(cell)])


def _search_block(asked: pd.DataFrame, table: DataFrame, spec: nn.Spec, schema, vec: str, payload: Sequence[str]) -> DataFrame:  # noqa: ANN001
    probed = sorted({int(c) for cells in asked["cells"] for c in cells})
    rows = _scored_columns(table.filter(F.col("cell").isin(*probed) if probed else F.lit(False)), spec, vec, payload)
    shared = table.sparkSession.sparkContext.broadcast(asked)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = shared.value
        by_cell = _rows_by_cell(queries["cells"])
        best = nn._all_best(queries, spec, payload)  # all of one length: one or none
        for frame in frames:
            for part in best:
                _meet_cells(part, by_cell, frame)
        for part in best:
            yield from part.frames()

    return rows.mapInPandas(run, schema)


def runs_of_cells(counts: list[tuple[int, int]], height: int) -> list[tuple[int, int, int]]:
    """Cells in runs of neighbours with about ``height`` rows: (first cell, last cell, parts that the run's rows are dealt to, for a cell may be larger)."""
    out: list[tuple[int, int, int]] = []
    first, held = None, 0
    for i, (cell, n) in enumerate(counts):
        first, held = cell if first is None else first, held + n
        if i + 1 == len(counts) or held + counts[i + 1][1] > height:
            out.append((first, cell, -(-held // height)))
            first, held = None, 0
    return out


def _search_grid(asked: DataFrame, n: int, rows: DataFrame, spec: nn.Spec, schema, payload: Sequence[str]) -> DataFrame:  # noqa: ANN001
    counts = sorted((r["cell"], r["n"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row for each cell
    height = nn.block_rows(n, sum(c for _, c in counts), rows.sparkSession.sparkContext.defaultParallelism)
    runs = runs_of_cells(counts, height)
    wide = max(1, -(-n // nn.CELL_QUERIES))
    table = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(parts).alias("parts")) for i, (lo, hi, parts) in enumerate(runs)])
    # A query goes to the runs that hold some of its cells, with those.
    mine = F.transform(table, lambda r: F.struct(r["run"].alias("run"), F.filter("cells", lambda c: (c >= r["lo"]) & (c <= r["hi"])).alias("mine"), r["parts"].alias("parts")))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("__qid"), F.lit(wide)).cast("int")).select("__qid", "__qv", "qb", F.inline(F.filter(mine, lambda r: F.size(r["mine"]) > 0)))
    left = left.withColumnRenamed("mine", "cells").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    at = F.filter(table, lambda r: (F.col("cell") >= r["lo"]) & (F.col("cell") <= r["hi"]))[0]
    right = rows.withColumn("at", at).withColumn("run", F.col("at.run")).withColumn("part", F.pmod(F.xxhash64("__vid"), F.col("at.parts")).cast("int")).drop("at")
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return empty(schema.names)
        best = nn._all_best(a, spec, payload)
        for part in best:
            _meet_cells(part, _rows_by_cell(a["cells"]), b)
        return nn._together(best, schema.names)

    keys = ["qb", "run", "part"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
    return nn._ranked(scored, spec, len(runs))
