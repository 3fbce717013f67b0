"""Diversified selection: maximal marginal relevance (Carbonell and Goldstein, 1998), with lazy re-scoring.

The gain of a candidate only falls as more is picked, so its last known gain bounds what it is worth now. A round scores each
query's leader by bound anew and then only the candidates whose bound reaches the leader's gain; the best of those
is the pick. Candidates stay spread over the tasks, whatever their number per query; only the picks (a few per query) meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.session import materialize, release

DECIMALS = 6


def _gain(lam: float) -> Column:
    nearest = F.array_max(F.transform("__picks", lambda p: sc.cosine(F.col("embedding"), p)))
    return F.round(lam * F.col("score") - (1 - lam) * nearest, DECIMALS)


def mmr(cands: DataFrame, k: int = 5, lam: float = 0.5, cid: str = "chunk_id") -> DataFrame:
    """Greedy pick of ``k`` per query maximising ``lam * score - (1 - lam) * max similarity to the picked``: ``qid``, the id, ``rank, mmr``.

    ``cands`` holds qid, the candidate id, score (similarity to the query) and embedding. The first pick is the one with the best score,
    and its ``mmr`` is that score. Gains are rounded to six digits; ties go to the smaller id.
    """
    rows = materialize(cands.select("qid", F.col(cid).alias("__cid"), F.col("score").cast("double").alias("score"), "embedding"), "mmr")
    first = rows.select("qid", "__cid", F.round("score", DECIMALS).alias("__gain"))
    chosen = materialize(_best(first), "picks")
    picked = chosen.select("qid", "__cid", F.lit(1).alias("rank"), F.col("__gain").alias("mmr"))
    # Nothing is less similar than -1: a bound for those that haven't met a pick.
    bounds = rows.select("qid", "__cid", F.round(lam * F.col("score") + (1 - lam), DECIMALS).alias("bound"))
    for rank in range(2, k + 1):
        vectors = rows.join(picked.select("qid", "__cid"), ["qid", "__cid"], "left_semi").groupBy("qid").agg(F.collect_list("embedding").alias("__picks"))  # k at most
        vectors = materialize(vectors, "picked")
        left = bounds.join(chosen.select("qid", "__cid"), ["qid", "__cid"], "left_anti")
        left = materialize(left, "bounds")
        leaders = _best(left.withColumnRenamed("bound", "__gain")).select("qid", "__cid")
        least = leaders.join(rows, ["qid", "__cid"]).join(vectors, "qid").select("qid", _gain(lam).alias("least"))
        least = materialize(least, "least")
        open_ = left.join(least, "qid").filter(F.col("bound") >= F.col("least")).select("qid", "__cid")
        exact = materialize(open_.join(rows, ["qid", "__cid"]).join(vectors, "qid").select("qid", "__cid", _gain(lam).alias("__gain")), "gains")
        chosen = materialize(_best(exact), "picks")
        picked = picked.unionByName(chosen.select("qid", "__cid", F.lit(rank).alias("rank"), F.col("__gain").alias("mmr")))
        bounds = left.join(exact, ["qid", "__cid"], "left").select("qid", "__cid", F.coalesce("__gain", "bound").alias("bound"))
        release(vectors, least)
    return picked.withColumnRenamed("__cid", cid)


def _best(gains: DataFrame) -> DataFrame:
    """The best row of each query by ``__gain``, ties to the smaller id: an aggregate with map-side combine."""
    best = gains.groupBy("qid").agg(F.min(F.struct((-F.col("__gain")).alias("loss"), F.col("__cid").alias("cid"))).alias("b"))
    return best.select("qid", F.col("b.cid").alias("__cid"), (-F.col("b.loss")).alias("__gain"))
