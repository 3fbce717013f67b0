"""Scoring, blending and reranking of retrieval candidates.

A candidate set holds at most fetch_k rows per query, so per-query windows stay small whatever the corpus size.
Order is total everywhere: ties fall to the smaller candidate id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as tx

# Defaults of the retrieval settings.
K, FETCH_K, RERANK_CAP = 5, 25, 10
ALPHA, FLOOR = 0.7, 0.3
WEIGHTS = {"dense": 0.6, "bm25": 0.4}
K1, B, EPSILON = 1.5, 0.75, 0.25
PREVIEW = 240

PairScorer = Callable[[pd.Series, pd.Series], pd.Series]


def top(df: DataFrame, k: int | Column, order: Sequence[Column | str], by: str = "qid", out: str = "rank") -> DataFrame:
    """First ``k`` rows per query in ``order``; ``k`` may differ per row."""
    w = Window.partitionBy(by).orderBy(*order)
    limit = F.lit(k) if isinstance(k, int) else k
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= limit)


def dist_to_sim(df: DataFrame, dist: str = "distance", out: str = "v_sim", by: str = "qid", floor: float = 0.0) -> DataFrame:
    """``(max - d) / (max - min)`` per query; 1.0 when all are equal; the denominator is at least ``floor``."""
    w = Window.partitionBy(by)
    lo, hi = F.min(dist).over(w), F.max(dist).over(w)
    width = F.greatest(hi - lo, F.lit(float(floor)))
    return df.withColumn("__lo", lo).withColumn("__hi", hi).withColumn("__w", width).withColumn(
        out, F.when(F.col("__lo") == F.col("__hi"), 1.0).otherwise((F.col("__hi") - F.col(dist)) / F.nullif(F.col("__w"), F.lit(0.0)))
    ).drop("__lo", "__hi", "__w")


def minmax(df: DataFrame, score: str, out: str, by: str = "qid") -> DataFrame:
    """Min-max normalised score per query; 1.0 when all are equal."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("__lo", lo).withColumn("__hi", hi).withColumn(
        out,
        F.when(F.col("__lo") == F.col("__hi"), 1.0).otherwise(
            (F.col(score) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
        ),
    ).drop("__lo", "__hi")


def hybrid_tf(
    cands: DataFrame, alpha: float = ALPHA, k: int = K, dist: str = "distance", cid: str = "chunk_id", floor: float = FLOOR
) -> DataFrame:
    """``alpha * similarity + (1 - alpha) * tf / max tf`` per query; keeps v_sim, tf and blended."""
    a = max(0.0, min(1.0, alpha))
    scored = dist_to_sim(cands, dist, "v_sim", floor=floor).withColumn("tf", tx.tf_score(F.col("query"), F.col("text")))
    peak = F.max("tf").over(Window.partitionBy("qid"))
    scored = scored.withColumn("__peak", peak).withColumn(
        "blended",
        F.round(F.lit(a) * F.col("v_sim") + F.lit(1 - a) * F.col("tf") / F.when(F.col("__peak") == 0, 1.0).otherwise(F.col("__peak")), 6),
    ).drop("__peak")
    return top(scored, k, [F.col("blended").desc(), F.round("v_sim", 6).desc(), F.col(cid)])


def bm25(
    cands: DataFrame, k: int | None = None, k1: float = K1, b: float = B, epsilon: float = EPSILON, cid: str = "chunk_id"
) -> DataFrame:
    """BM25-Okapi of each candidate inside its own query's candidate set.

    idf = ln((N - df + 0.5) / (df + 0.5)); negative values become ``epsilon`` times the mean idf of all terms
    of the candidate set. Query tokens count as often as they occur. Adds ``bm25`` (rounded to six digits).
    """
    per_query = Window.partitionBy("qid")
    base = (
        cands.select("qid", F.col(cid).alias("__cid"), tx.tokens(F.col("text")).alias("__toks"), tx.tokens(F.col("query")).alias("__asked"))
        .repartition("qid")
        .withColumn("__n", F.count("*").over(per_query))
        .withColumn("__avgdl", F.avg(F.size("__toks")).over(per_query))
    )

    def idf(df: Column) -> Column:
        return F.log((F.col("__n") - df + 0.5) / (df + 0.5))

    # Mean idf over every term of the candidate set: counts only, combined per query and term.
    mean = (
        base.select("qid", "__n", F.explode(F.array_distinct("__toks")).alias("term"))
        .groupBy("qid", "term", "__n").agg(F.count("*").alias("__df"))
        .groupBy("qid").agg(F.avg(idf(F.col("__df"))).alias("__mean"))
    )

    def times(tokens: Column, t: Column) -> Column:
        return F.size(F.filter(tokens, lambda x: x == t))

    # Scores need the asked terms only; a term's document frequency is its number of rows per query.
    hits = base.select(
        "qid", "__cid", "__n", "__avgdl", F.size("__toks").alias("__dl"),
        F.inline(F.transform(
            F.array_intersect("__toks", "__asked"),
            lambda t: F.struct(t.alias("term"), times(F.col("__toks"), t).alias("__tf"), times(F.col("__asked"), t).alias("__qtf")),
        )),
    ).withColumn("__raw", idf(F.count("*").over(Window.partitionBy("qid", "term"))))
    weight = F.col("__qtf") * F.when(F.col("__raw") < 0, F.lit(epsilon) * F.col("__mean")).otherwise(F.col("__raw")) * F.col("__tf") * (k1 + 1) / (
        F.col("__tf") + k1 * (1 - b + b * F.col("__dl") / F.col("__avgdl"))
    )
    scores = hits.join(mean, "qid").groupBy("qid", F.col("__cid").alias(cid)).agg(F.sum(weight).alias("__bm25"))
    out = cands.join(scores, ["qid", cid], "left").withColumn("bm25", F.round(F.coalesce("__bm25", F.lit(0.0)), 6)).drop("__bm25")
    return out if k is None else top(out, k, [F.col("bm25").desc(), F.col(cid)])


def blend(
    dense: DataFrame, lexical: DataFrame, weights: dict[str, float] | DataFrame | None = None, k: int = K,
    dense_score: str = "v_sim", lexical_score: str = "bm25",
) -> DataFrame:
    """Weighted sum of both normalised scores per (query, source, page), top ``k``.

    Chunks that share a page add up. ``weights`` is a dict, or a table with ``name`` and ``weight`` rows that
    overrides the defaults.
    """
    if isinstance(weights, DataFrame):
        # One row per name, the newest (by ts if there is one) where a name is repeated.
        newest = F.max_by("weight", F.struct("ts", "weight")) if "ts" in weights.columns else F.max("weight")
        override = {r["name"]: r["weight"] for r in weights.filter(F.col("name").isin("dense", "bm25")).groupBy("name").agg(newest.alias("weight")).collect()}
    else:
        override = weights or {}
    w = {side: F.lit(float(override.get(side, default))) for side, default in WEIGHTS.items()}
    if dense is lexical:
        # Both scores on one candidate set: no union needed.
        both = minmax(minmax(dense, dense_score, "__d"), lexical_score, "__x").select(
            "qid", "source", "page", (w["dense"] * F.col("__d") + w["bm25"] * F.col("__x")).alias("__part")
        )
    else:
        both = minmax(dense, dense_score, "__s").select("qid", "source", "page", (w["dense"] * F.col("__s")).alias("__part")).unionByName(
            minmax(lexical, lexical_score, "__s").select("qid", "source", "page", (w["bm25"] * F.col("__s")).alias("__part"))
        )
    summed = both.groupBy("qid", "source", "page").agg(F.round(F.sum("__part"), 6).alias("blended"))
    return top(summed, k, [F.col("blended").desc(), "source", "page"])


def blend_chunks(
    scored: DataFrame, weights: dict[str, float] | None = None, k: int = K, rank: str = "rk", cid: str = "chunk_id",
    dense_score: str = "v_sim", lexical_score: str = "bm25",
) -> DataFrame:
    """``blend`` and ``best_chunk_per_key`` in one pass over a set holding both scores; keeps all its columns.

    Adds ``blended`` and ``blend_rank``; each page shows its last-ranked candidate.
    """
    w = {**WEIGHTS, **(weights or {})}
    both = minmax(minmax(scored.repartition("qid"), dense_score, "__d"), lexical_score, "__x")
    page = Window.partitionBy("qid", "source", "page")
    part = F.lit(float(w["dense"])) * F.col("__d") + F.lit(float(w["bm25"])) * F.col("__x")
    summed = both.withColumn("blended", F.round(F.sum(part).over(page), 6)).withColumn(
        "__last", F.row_number().over(page.orderBy(F.col(rank).desc(), F.col(cid).desc()))
    )
    pages = summed.filter("__last = 1").drop("__last", "__d", "__x")
    return top(pages, k, [F.col("blended").desc(), "source", "page"], out="blend_rank")


def best_chunk_per_key(blended: DataFrame, cands: DataFrame, k: int = K, rank: str = "rk", cid: str = "chunk_id") -> DataFrame:
    """One chunk per blended page: the last-ranked candidate of that page, first ``k`` pages."""
    last = cands.groupBy("qid", "source", "page").agg(F.max_by(cid, F.struct(rank, cid)).alias(cid))
    return blended.filter(F.col("rank") <= k).join(last, ["qid", "source", "page"])


def rerank(cands: DataFrame, scorer: PairScorer | None = None, top_k: int | None = None, cid: str = "chunk_id") -> DataFrame:
    """Order by a pair score, best first; without a scorer the term-frequency score is used."""
    if scorer is None:
        scored = cands.withColumn("rerank_score", tx.tf_score(F.col("query"), F.col("text")))
    else:

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for queries, texts in batches:
                yield scorer(queries, texts).astype("float64")

        scored = cands.withColumn("rerank_score", score(F.col("query"), F.col("text")))
    order = [F.col("rerank_score").desc(), F.col(cid)]
    if top_k is None:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return top(scored, top_k, order)


def rerank_capped(
    cands: DataFrame, cap: int, order: str = "rk", scorer: PairScorer | None = None, cid: str = "chunk_id"
) -> DataFrame:
    """Only the first ``cap`` candidates are reranked and kept; ``n_cut`` says how many of a query's were left out.

    Equal scores keep their earlier order.
    """
    sizes = cands.groupBy("qid").agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("n_cut"))
    kept = top(cands, max(1, cap), [order, cid], out="__cap").drop("__cap").join(sizes, "qid")
    scored = rerank(kept, scorer, cid=cid).drop("rank")
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), F.col(order), F.col(cid))
    return scored.withColumn("rank", F.row_number().over(w))


def retrieval_depth(df: DataFrame, intent: str = "intent") -> DataFrame:
    """k and fetch_k per row from its intent and the limits k_min, k_max, fetch_min, fetch_max."""
    i = F.col(intent)
    mid = F.floor((F.col("fetch_min") + F.col("fetch_max")) / 2).cast("int")
    return df.withColumn(
        "k_eff",
        F.when(i == "lookup", F.col("k_min")).when(i == "troubleshoot", F.least("k_max", F.col("k_min") + 4)).otherwise(F.col("k_max")),
    ).withColumn("fetch_eff", F.when(i == "lookup", F.greatest(F.col("fetch_min"), mid)).otherwise(F.col("fetch_max")))


def explain_rows(ranked: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """Per returned source: a text preview and the score parts."""
    return ranked.select(
        "qid", "rank", "source", "page", F.substring("text", 1, max(0, preview)).alias("preview"),
        F.col("blended").alias("score"), "v_sim", "tf",
    )


def confidence(answers: DataFrame, blended: DataFrame, k: int = K) -> DataFrame:
    """Confidence in 0..1 from result count, answer length, the margin of the two best blends, and reranking.

    ``answers``: qid, n_docs, answer, rerank_enabled. ``blended``: qid, rank, blended.
    """
    edge = blended.filter(F.col("rank") <= 2).groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("blended"))).alias("__a"),
        F.max(F.when(F.col("rank") == 2, F.col("blended"))).alias("__b"),
    )
    gap = F.when(F.col("__b").isNotNull(), F.greatest(F.lit(0.0), F.col("__a") - F.col("__b"))).otherwise(0.0)
    score = (
        F.least(F.col("n_docs"), F.lit(k)) / F.lit(float(max(1, k))) * 0.2
        + F.least(F.length(F.coalesce("answer", F.lit(""))), F.lit(400)) / 400.0 * 0.2
        + F.least(gap, F.lit(0.5)) * 0.4
        + F.when(F.col("rerank_enabled"), 0.2).otherwise(0.0)
    )
    return answers.join(edge, "qid", "left").withColumn(
        "confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
    ).drop("__a", "__b")
