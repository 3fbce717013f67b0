"""Bulk retrieval: filtered vector search, lexical blend, re-filter, rerank, cited sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import embed as em
from siftwell.operators import filters as fl
from siftwell.operators import ranking as rk
from siftwell.operators.knn import knn
from siftwell.session import materialize


def text_candidates(
    queries: DataFrame, chunks: DataFrame, fetch_k: int = rk.FETCH_K, embedder: em.Embedder | None = None, match: tuple[str, ...] = ()
) -> DataFrame:
    """Best ``fetch_k`` chunks per query by embedding similarity, with their text.

    Stored vectors (``embedding``) are searched without reading any text; without them chunks are embedded where they
    are scored. Only ids leave the search; text joins afterwards for the few rows that won.
    """
    model = embedder or em.HashedCounts()
    asked = em.embed(queries.select("qid", "query", *match), model, text="query", keep=["qid", *match])
    if "embedding" in chunks.columns:
        nearest = knn(asked, chunks, fetch_k, vid="chunk_id", match=match, payload=[c for c in ("folder",) if c in chunks.columns])
    else:
        nearest = knn(asked, chunks, fetch_k, vid="chunk_id", vvec="text", match=match, embedder=model)
    # Written, the winners have a size that the planner knows: it ships them to the text instead of moving that.
    found = materialize(nearest.withColumnRenamed("rank", "rk"), "nearest")
    text = chunks.drop("embedding")
    if "folder" in found.columns:
        # Only the winners' folders are read: a list no longer than the index has folders.
        folders = [r["folder"] for r in found.select("folder").distinct().collect()]
        text = text.filter(F.col("folder").isin(*folders) if folders else F.lit(False)).drop("folder")
        found = found.drop("folder")
    rows = text.join(found, "chunk_id").join(queries.select("qid", "query"), "qid").withColumn("distance", 1 - F.col("score"))
    # Later steps read the candidates several times; written once, the corpus is not scanned again.
    return materialize(rows, "candidates")


def bulk_retrieve(
    queries: DataFrame, chunks: DataFrame, deny: DataFrame | None = None, filters: fl.Filters | None = None,
    k: int = rk.K, fetch_k: int = rk.FETCH_K, cap: int = rk.RERANK_CAP, embedder: em.Embedder | None = None,
    weights: dict[str, float] | None = None, scorer: rk.PairScorer | None = None,
) -> DataFrame:
    """Cited chunks per query after filter, vector search, BM25 blend, denylist and rerank."""
    scope = chunks if filters is None else fl.apply_filters(chunks, filters)
    cands = text_candidates(queries, scope, fetch_k, embedder)
    scored = rk.bm25(rk.dist_to_sim(cands))
    docs = rk.blend_chunks(scored, weights, k)
    if deny is not None:
        docs = fl.exclude_denied(docs, deny)
    return rk.rerank_capped(docs, cap, order="blend_rank", scorer=scorer)
