"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions import text as tx
from siftwell.operators import bm25 as corpus
from siftwell.operators import cells as cl
from siftwell.operators import embed as em
from siftwell.operators import filters as fl
from siftwell.operators import knn as nn
from siftwell.operators import mmr as dv
from siftwell.operators import ranking as rk
from siftwell.operators import review as rv
from siftwell.plans import bulk
from siftwell.plans import views as vw
from siftwell.plans.registry import query
from siftwell.session import local_table, materialize

# ---- candidate sets shared by the SQL twins ----------------------------------------------------------
C = "WITH " + vw.SQL_CANDS
WS = vw._WS_SQL

_SIM = """, sim AS (SELECT *, 1 - score AS distance,
   CASE WHEN max(1 - score) OVER q = min(1 - score) OVER q THEN 1.0
        ELSE (max(1 - score) OVER q - (1 - score)) / (max(1 - score) OVER q - min(1 - score) OVER q) END AS v_sim
   FROM cands WINDOW q AS (PARTITION BY qid))"""
_TOKENS = f"list_filter(regexp_split_to_array(lower(%s), '{WS}'), lambda x: x <> '')"
_TF = "coalesce(list_sum(list_transform(" + _TOKENS % "query" + ", lambda t: CAST((length(lower(text)) - length(replace(lower(text), t, ''))) / length(t) AS BIGINT))), 0)"
_BM = f""", ct AS (SELECT qid, chunk_id, unnest({_TOKENS % 'text'}) AS term FROM cands),
 ctf AS (SELECT qid, chunk_id, term, count(*) AS tf FROM ct GROUP BY ALL),
 cdl AS (SELECT qid, chunk_id, len({_TOKENS % 'text'}) AS dl FROM cands),
 cst AS (SELECT qid, count(*) AS n, avg(dl) AS avgdl FROM cdl GROUP BY qid),
 cdf AS (SELECT qid, term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM ctf JOIN cst USING (qid) GROUP BY qid, term),
 cmean AS (SELECT qid, avg(raw) AS m FROM cdf GROUP BY qid),
 qtf AS (SELECT qid, t AS term, count(*) AS qtf FROM qtok GROUP BY ALL),
 bm AS (SELECT qid, chunk_id, sum(qtf * CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
        FROM ctf JOIN qtf USING (qid, term) JOIN cdf USING (qid, term) JOIN cmean USING (qid) JOIN cst USING (qid) JOIN cdl USING (qid, chunk_id)
        GROUP BY qid, chunk_id),
 lex AS (SELECT sim.*, round(coalesce(s, 0.0), 6) AS bm25 FROM sim LEFT JOIN bm USING (qid, chunk_id))"""
_BLEND = """, nrm AS (SELECT *,
   CASE WHEN max(v_sim) OVER q = min(v_sim) OVER q THEN 1.0 ELSE (v_sim - min(v_sim) OVER q) / (max(v_sim) OVER q - min(v_sim) OVER q) END AS dn,
   CASE WHEN max(bm25) OVER q = min(bm25) OVER q THEN 1.0 ELSE (bm25 - min(bm25) OVER q) / (max(bm25) OVER q - min(bm25) OVER q) END AS ln
   FROM lex WINDOW q AS (PARTITION BY qid)),
 blended AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY blended DESC, source, page) AS rank FROM (
    SELECT qid, source, page, round(sum(0.6 * dn + 0.4 * ln), 6) AS blended FROM nrm GROUP BY qid, source, page)) WHERE rank <= 5),
 chosen AS (SELECT qid, source, page, blended, rank, arg_max(chunk_id, rk) AS chunk_id FROM blended JOIN lex USING (qid, source, page) GROUP BY ALL)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk.text_candidates(vw.text_queries(spark, sf_dir), vw.stored_chunks(spark, sf_dir))


def all_vectors_as_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vw.vectors(spark, sf_dir)
    return v.select(F.col("vec_id").alias("qid"), "tenant", "doc_type", "embedding"), v


_PAIRS = "WITH " + vw.SQL_VECTORS + """, scored AS (
  SELECT q.vec_id AS qid, v.vec_id, v.source, v.page, v.doc_type, q.doc_type AS q_doc_type, v.tenant, q.tenant AS q_tenant,
         round({expr}, 6) AS score FROM vectors q JOIN vectors v ON q.vec_id <> v.vec_id)
  SELECT qid, vec_id, source, page, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM scored {where}) WHERE rank <= {k}"""


@query("j1_exact_neighbours", _PAIRS.format(expr="list_inner_product(q.embedding, v.embedding)", where="", k=25))
def j1(spark, sf_dir):
    """Every vector against every other, inner product, best 25."""
    q, v = all_vectors_as_queries(spark, sf_dir)
    return nn.knn(q, v, 25, metric="ip", payload=["source", "page"], exclude_self=True).select("qid", "vec_id", "source", "page", "score", "rank")


@query("v2_vector_top_k", _PAIRS.format(expr="list_cosine_similarity(q.embedding, v.embedding)", where="", k=5))
def v2(spark, sf_dir):
    q, v = all_vectors_as_queries(spark, sf_dir)
    return nn.knn(q, v, 5, payload=["source", "page"], exclude_self=True).select("qid", "vec_id", "source", "page", "score", "rank")


@query(
    "f1_filtered_neighbours",
    _PAIRS.format(expr="list_cosine_similarity(q.embedding, v.embedding)", where="WHERE doc_type IN ('1', '2', '3') AND source IN ('src1', 'src5', 'src9', 'src14')", k=5),
)
def f1_vectors(spark, sf_dir):
    """Metadata filter below the search: it reaches the scan before any vector is scored."""
    q, v = all_vectors_as_queries(spark, sf_dir)
    scope = fl.apply_filters(v, fl.Filters(sources=["src1", "src5", "src9", "src14"])).filter(F.col("doc_type").isin("1", "2", "3"))
    return nn.knn(q, scope, 5, payload=["source", "page"], exclude_self=True).select("qid", "vec_id", "source", "page", "score", "rank")


@query(
    "f5_tenant_neighbours",
    _PAIRS.format(expr="list_cosine_similarity(q.embedding, v.embedding)", where="WHERE tenant = q_tenant AND doc_type = q_doc_type", k=5),
)
def f5_vectors(spark, sf_dir):
    """Each query sees the vectors of its own tenant and doc type only."""
    q, v = all_vectors_as_queries(spark, sf_dir)
    asked = fl.enforce_tenant(q.withColumn("caller_tenant", F.col("tenant")).withColumn("tenant", F.lit("any")))
    return nn.knn(asked, v, 5, payload=["source", "page"], match=["tenant", "doc_type"], exclude_self=True).select(
        "qid", "vec_id", "source", "page", "score", "rank"
    )


@query("j2_cell_neighbours")
def j2(spark, sf_dir):
    """Search of the stored cells, as many per query as the index says; the next two queries check it."""
    q, _ = all_vectors_as_queries(spark, sf_dir)
    return cl.search_cells(q, vw.stored_cells(spark, sf_dir), 5, exclude_self=True).select("qid", "vec_id", "score", "rank")


@query("j2_all_cells", _PAIRS.replace("source, page, ", "").format(expr="list_cosine_similarity(q.embedding, v.embedding)", where="", k=5))
def j2_all(spark, sf_dir):
    """With every cell probed the search is exact."""
    q, _ = all_vectors_as_queries(spark, sf_dir)
    cells = vw.stored_cells(spark, sf_dir)
    return cl.search_cells(q, cells, 5, len(cells.centres), exclude_self=True).select("qid", "vec_id", "score", "rank")


@query("j2_cell_recall", "SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE len(embedding) > 0")
def j2_recall(spark, sf_dir):
    """Whether the cells that the index probes hold nine tenths of the true ten neighbours of all vectors."""
    q, v = all_vectors_as_queries(spark, sf_dir)
    near = cl.search_cells(q, vw.stored_cells(spark, sf_dir), 10, exclude_self=True).select("qid", "vec_id", F.lit(1).alias("hit"))
    both = nn.knn(q, v, 10, exclude_self=True).select("qid", "vec_id").join(near, ["qid", "vec_id"], "left")
    per_query = both.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return per_query.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.88).alias("recall_reached"))


@query("v1_cosine", "WITH " + vw.SQL_VECTORS + """ SELECT a.vec_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine
   FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1""")
def v1(spark, sf_dir):
    """Cosine as a column expression, each vector with its successor."""
    v = vw.vectors(spark, sf_dir).select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("x15_vector_math", "WITH " + vw.SQL_VECTORS + """ SELECT a.vec_id, round(list_inner_product(a.embedding, b.embedding), 6) AS dot,
   round(sqrt(list_inner_product(a.embedding, a.embedding)), 6) AS norm,
   round(greatest(0.0, least(0.1, list_inner_product(a.embedding, b.embedding))), 6) AS clamped,
   CAST(round_even(0.95 * (a.vec_id % 50), 0) AS BIGINT) AS half_even
   FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1""")
def x15(spark, sf_dir):
    v = vw.vectors(spark, sf_dir).select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = sc.dot(F.col("embedding"), F.col("other"))
    return v.join(nxt, "vec_id").select(
        "vec_id", F.round(d, 6).alias("dot"), F.round(sc.norm(F.col("embedding")), 6).alias("norm"),
        F.round(sc.clamp(d, 0.0, 0.1), 6).alias("clamped"), F.bround(F.lit(0.95) * (F.col("vec_id") % 50)).cast("long").alias("half_even"),
    )


@query("i6_hashed_embedding", "WITH " + vw.SQL_CHUNKS + f""", tok AS (SELECT chunk_id, unnest({_TOKENS % 'text'}) AS t FROM chunks)
   SELECT chunk_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % 64 AS BIGINT) AS bucket, CAST(count(*) AS DOUBLE) AS weight FROM tok GROUP BY ALL""")
def i6(spark, sf_dir):
    """Default embedder over every chunk, shown as its non-zero buckets."""
    v = em.embed(vw.chunks(spark, sf_dir).select("chunk_id", "text"), keep=["chunk_id"])
    return v.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight")).filter("weight <> 0").select(
        "chunk_id", F.col("bucket").cast("long").alias("bucket"), F.col("weight").cast("double").alias("weight")
    )


@query("v3_distance_to_similarity", C + _SIM + " SELECT qid, chunk_id, score, round(v_sim, 6) AS v_sim FROM sim")
def v3(spark, sf_dir):
    return rk.dist_to_sim(candidates(spark, sf_dir)).select("qid", "chunk_id", "score", F.round("v_sim", 6).alias("v_sim"))


@query("v4_floored_similarity", C + """ SELECT qid, chunk_id, round(CASE WHEN max(1 - score) OVER q = min(1 - score) OVER q THEN 1.0
   ELSE (max(1 - score) OVER q - (1 - score)) / greatest(max(1 - score) OVER q - min(1 - score) OVER q, 0.3) END, 6) AS v_sim
   FROM cands WINDOW q AS (PARTITION BY qid)""")
def v4(spark, sf_dir):
    return rk.dist_to_sim(candidates(spark, sf_dir), floor=rk.FLOOR).select("qid", "chunk_id", F.round("v_sim", 6).alias("v_sim"))


@query("v5_term_frequency", C + f" SELECT qid, chunk_id, CAST({_TF} AS DOUBLE) AS tf FROM cands")
def v5(spark, sf_dir):
    return candidates(spark, sf_dir).select("qid", "chunk_id", tx.tf_score(F.col("query"), F.col("text")).alias("tf"))


_HYBRID = f""", h0 AS (SELECT *, CAST({_TF} AS DOUBLE) AS tf, CASE WHEN max(1 - score) OVER q = min(1 - score) OVER q THEN 1.0
   ELSE (max(1 - score) OVER q - (1 - score)) / greatest(max(1 - score) OVER q - min(1 - score) OVER q, 0.3) END AS v_sim
   FROM cands WINDOW q AS (PARTITION BY qid)),
 h1 AS (SELECT *, round(0.7 * v_sim + (1 - 0.7) * tf / CASE WHEN max(tf) OVER q = 0 THEN 1.0 ELSE max(tf) OVER q END, 6) AS blended FROM h0 WINDOW q AS (PARTITION BY qid)),
 hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY blended DESC, round(v_sim, 6) DESC, chunk_id) AS rank FROM h1) WHERE rank <= 5)"""


@query("v6_hybrid_tf", C + _HYBRID + " SELECT qid, chunk_id, rank, blended, round(v_sim, 6) AS v_sim, tf FROM hybrid")
def v6(spark, sf_dir):
    return rk.hybrid_tf(candidates(spark, sf_dir)).select("qid", "chunk_id", "rank", "blended", F.round("v_sim", 6).alias("v_sim"), "tf")


@query("v7_candidate_bm25", C + _SIM + _BM + " SELECT qid, chunk_id, bm25 FROM lex")
def v7(spark, sf_dir):
    return rk.bm25(candidates(spark, sf_dir)).select("qid", "chunk_id", "bm25")


_CORPUS = f"""tok AS (SELECT chunk_id, unnest({_TOKENS % 'text'}) AS term FROM chunks), dls AS (SELECT chunk_id, len({_TOKENS % 'text'}) AS dl FROM chunks),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
 tfs AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
 dfs AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tfs, st GROUP BY term),
 mean AS (SELECT avg(raw) AS m FROM dfs),
 qtf AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_TOKENS % 'query'}) AS term FROM tq) GROUP BY ALL),
 s AS (SELECT qid, chunk_id, round(sum(qtf * CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
       FROM qtf JOIN tfs USING (term) JOIN dfs USING (term) JOIN dls USING (chunk_id), mean, st GROUP BY qid, chunk_id)"""
_TOP = "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, chunk_id) AS rank FROM s WHERE bm25 <> 0) WHERE rank <= 25"


@query("v7b_corpus_bm25", "WITH " + vw.SQL_CHUNKS + ", tq AS (SELECT item_id AS qid, text AS query FROM benchmark), " + _CORPUS + " SELECT qid, chunk_id, bm25, rank FROM " + _TOP)
def v7b(spark, sf_dir):
    """BM25 with corpus-wide statistics over every chunk."""
    return corpus.search_postings(vw.text_queries(spark, sf_dir), vw.stored_postings(spark, sf_dir)).select("qid", "chunk_id", "bm25", "rank")


@query("v8_minmax", C + _SIM + _BM + """ SELECT qid, chunk_id, round(CASE WHEN max(bm25) OVER q = min(bm25) OVER q THEN 1.0
   ELSE (bm25 - min(bm25) OVER q) / (max(bm25) OVER q - min(bm25) OVER q) END, 6) AS bm25_n FROM lex WINDOW q AS (PARTITION BY qid)""")
def v8(spark, sf_dir):
    return rk.minmax(rk.bm25(candidates(spark, sf_dir)), "bm25", "bm25_n").select("qid", "chunk_id", F.round("bm25_n", 6).alias("bm25_n"))


def lexical(spark, sf_dir):
    return rk.bm25(rk.dist_to_sim(candidates(spark, sf_dir)))


@query("v9_blend", C + _SIM + _BM + _BLEND + " SELECT qid, source, page, blended, rank FROM blended")
def v9(spark, sf_dir):
    both = lexical(spark, sf_dir)
    return rk.blend(both, both).select("qid", "source", "page", "blended", "rank")


@query("v9_blend_two_lists", C + _SIM + ", " + _CORPUS + """, lx AS (SELECT t.qid, chunks.source, chunks.page, t.bm25 FROM (SELECT * FROM """ + _TOP + """) t JOIN chunks USING (chunk_id)),
   ps AS (SELECT qid, source, page, 0.6 * CASE WHEN max(v_sim) OVER q = min(v_sim) OVER q THEN 1.0 ELSE (v_sim - min(v_sim) OVER q) / (max(v_sim) OVER q - min(v_sim) OVER q) END AS p FROM sim WINDOW q AS (PARTITION BY qid)
     UNION ALL SELECT qid, source, page, 0.4 * CASE WHEN max(bm25) OVER q = min(bm25) OVER q THEN 1.0 ELSE (bm25 - min(bm25) OVER q) / (max(bm25) OVER q - min(bm25) OVER q) END FROM lx WINDOW q AS (PARTITION BY qid))
   SELECT qid, source, page, blended, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY blended DESC, source, page) AS rank FROM (
     SELECT qid, source, page, round(sum(p), 6) AS blended FROM ps GROUP BY ALL)) WHERE rank <= 5""")
def v9_lists(spark, sf_dir):
    """The nearest 25 chunks against the 25 best of the corpus by BM25: most stand in one list only."""
    chunks = vw.stored_chunks(spark, sf_dir)
    best = corpus.search_postings(vw.text_queries(spark, sf_dir), vw.stored_postings(spark, sf_dir)).join(chunks.select("chunk_id", "source", "page"), "chunk_id")
    return rk.blend(rk.dist_to_sim(candidates(spark, sf_dir)), best).select("qid", "source", "page", "blended", "rank")


@query("j5_score_merge", C + _SIM + ", " + _CORPUS + """, lx AS (SELECT t.qid, chunks.source, chunks.page, t.bm25 FROM (SELECT * FROM """ + _TOP + """) t JOIN chunks USING (chunk_id)),
   d AS (SELECT qid, source, page, sum(v_sim) AS dense, count(*) AS n_dense FROM sim GROUP BY ALL), l AS (SELECT qid, source, page, sum(bm25) AS lexical, count(*) AS n_lexical FROM lx GROUP BY ALL)
   SELECT qid, source, page, round(coalesce(dense, 0.0), 6) AS dense, round(coalesce(lexical, 0.0), 6) AS lexical, coalesce(n_dense, 0) AS n_dense, coalesce(n_lexical, 0) AS n_lexical
   FROM d FULL JOIN l USING (qid, source, page)""")
def j5(spark, sf_dir):
    """The nearest 25 chunks and the 25 best by BM25 merged on (source, page): most stand on one side only."""
    chunks = vw.stored_chunks(spark, sf_dir).select("chunk_id", "source", "page")
    dense = rk.dist_to_sim(candidates(spark, sf_dir)).groupBy("qid", "source", "page").agg(F.sum("v_sim").alias("dense"), F.count("*").alias("n_dense"))
    best = corpus.search_postings(vw.text_queries(spark, sf_dir), vw.stored_postings(spark, sf_dir))
    lexical = best.join(chunks, "chunk_id").groupBy("qid", "source", "page").agg(F.sum("bm25").alias("lexical"), F.count("*").alias("n_lexical"))
    both = dense.join(lexical, ["qid", "source", "page"], "full")
    none = lambda c, zero: F.coalesce(F.col(c), F.lit(zero))
    return both.select(
        "qid", "source", "page", F.round(none("dense", 0.0), 6).alias("dense"), F.round(none("lexical", 0.0), 6).alias("lexical"),
        none("n_dense", 0).alias("n_dense"), none("n_lexical", 0).alias("n_lexical"),
    )


@query("v10_best_chunk", C + _SIM + _BM + _BLEND + " SELECT qid, source, page, blended, rank, chunk_id FROM chosen")
def v10(spark, sf_dir):
    both = lexical(spark, sf_dir)
    return rk.best_chunk_per_key(rk.blend(both, both), both).select("qid", "source", "page", "blended", "rank", "chunk_id")


def _greedy_sql(k: int, lam: float) -> str:
    """One CTE per pick."""
    steps = ["p1 AS (SELECT qid, vec_id, 1 AS rank, score AS mmr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rn FROM near) WHERE rn = 1)"]
    for r in range(2, k + 1):
        steps.append(f"""p{r} AS (SELECT * FROM p{r - 1} UNION ALL SELECT qid, vec_id, {r} AS rank, mmr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mmr DESC, vec_id) AS rn FROM (
     SELECT n.qid, n.vec_id, round({lam} * any_value(n.score) - {1 - lam} * max(list_cosine_similarity(a.embedding, b.embedding)), 6) AS mmr
     FROM near n JOIN p{r - 1} p USING (qid) JOIN vectors a ON a.vec_id = n.vec_id JOIN vectors b ON b.vec_id = p.vec_id
     WHERE NOT EXISTS (SELECT 1 FROM p{r - 1} x WHERE x.qid = n.qid AND x.vec_id = n.vec_id) GROUP BY n.qid, n.vec_id)) WHERE rn = 1)""")
    near = _PAIRS.format(expr="list_cosine_similarity(q.embedding, v.embedding)", where="", k=25)
    head, tail = near.split("SELECT qid, vec_id, source", 1)
    return head.rstrip() + ", near AS (SELECT qid, vec_id, source" + tail + "), " + ", ".join(steps) + f" SELECT qid, vec_id, rank, mmr FROM p{k}"


@query("v11_diversified", _greedy_sql(5, 0.5))
def v11(spark, sf_dir):
    """Maximal marginal relevance over the 25 nearest vectors of every vector."""
    q, v = all_vectors_as_queries(spark, sf_dir)
    near = nn.knn(q, v, rk.FETCH_K, exclude_self=True).join(v.select("vec_id", "embedding"), "vec_id")
    return dv.mmr(near, cid="vec_id").select("qid", "vec_id", "rank", "mmr")


@query("v12_rerank", C + f""" SELECT qid, chunk_id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, chunk_id) AS rank
   FROM (SELECT *, CAST({_TF} AS DOUBLE) AS rerank_score FROM cands)) WHERE rank <= 5""")
def v12(spark, sf_dir):
    return rk.rerank(candidates(spark, sf_dir), top_k=5).select("qid", "chunk_id", "rerank_score", "rank")


@query("v13_rerank_capped", C + f""" SELECT qid, chunk_id, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rk) AS rank, n_cut
   FROM (SELECT *, CAST({_TF} AS DOUBLE) AS rerank_score FROM (SELECT *, greatest(count(*) OVER (PARTITION BY qid) - 10, 0) AS n_cut FROM cands) WHERE rk <= 10)""")
def v13(spark, sf_dir):
    return rk.rerank_capped(candidates(spark, sf_dir), 10).select("qid", "chunk_id", "rerank_score", "rank", "n_cut")


@query("v15_explain", C + _HYBRID + " SELECT qid, rank, source, page, substr(text, 1, 240) AS preview, blended AS score, round(v_sim, 6) AS v_sim, tf FROM hybrid")
def v15(spark, sf_dir):
    return rk.explain_rows(rk.hybrid_tf(candidates(spark, sf_dir))).withColumn("v_sim", F.round("v_sim", 6))


_CONF = """, docs_n AS (SELECT qid, count(*) AS n_docs FROM chosen GROUP BY qid),
 ans AS (SELECT qid, text AS answer FROM chosen c JOIN lex USING (qid, chunk_id) WHERE c.rank = 1),
 edge AS (SELECT qid, max(blended) FILTER (rank = 1) AS a, max(blended) FILTER (rank = 2) AS b FROM blended GROUP BY qid),
 conf AS (SELECT qid, round(greatest(0.0, least(1.0, least(n_docs, 5) / 5.0 * 0.2 + least(length(answer), 400) / 400.0 * 0.2
   + least(CASE WHEN b IS NOT NULL THEN greatest(0.0, a - b) ELSE 0.0 END, 0.5) * 0.4 + CASE WHEN qid % 2 = 0 THEN 0.2 ELSE 0.0 END)), 6) AS confidence
   FROM ans JOIN docs_n USING (qid) JOIN edge USING (qid))"""


def answers(spark, sf_dir):
    pages = materialize(rk.blend_chunks(lexical(spark, sf_dir)), "pages").withColumn("rank", F.col("blend_rank"))
    rows = pages.groupBy("qid").agg(F.count("*").alias("n_docs"), F.min_by("text", "rank").alias("answer"))
    return rk.confidence(rows.withColumn("rerank_enabled", F.col("qid") % 2 == 0), pages)


@query("v16_confidence", C + _SIM + _BM + _BLEND + _CONF + " SELECT qid, confidence FROM conf")
def v16(spark, sf_dir):
    return answers(spark, sf_dir).select("qid", "confidence")


@query("b12_review_queue", C + _SIM + _BM + _BLEND + _CONF + " SELECT qid, confidence, 'low_conf' AS review_reason FROM conf WHERE confidence < 0.55")
def b12(spark, sf_dir):
    """Low-confidence part of the review queue."""
    rows = answers(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("qid")))
    return rv.hitl_queue(rows, threshold=0.55, rate=0.0).select("qid", "confidence", "review_reason")


@query("b12_review_queue_sampled", C + _SIM + _BM + _BLEND + _CONF + """ SELECT qid, confidence, CASE WHEN confidence < 0.45 THEN 'low_conf' ELSE 'sample' END AS review_reason FROM conf
   WHERE confidence < 0.45 OR CAST('0x' || substr(md5('0:' || qid), 1, 8) AS BIGINT) % 1000000 < 300000 ORDER BY qid DESC LIMIT 100""")
def b12_sampled(spark, sf_dir):
    """The newest page of the queue."""
    rows = answers(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("qid")))
    return rv.review_page(rv.hitl_queue(rows, threshold=0.45, rate=0.3)).select("qid", "confidence", "review_reason")


_DENIED = "('src3', 'src7')"


@query("v17_bulk_retrieve", C.replace("FROM documents)", "FROM documents WHERE lang <> 'fr')") + _SIM + _BM + _BLEND + f""",
 d AS (SELECT c.qid, c.chunk_id, c.source, c.page, c.blended, c.rank AS blend_rank, l.query, l.text FROM chosen c JOIN lex l USING (qid, chunk_id) WHERE c.source NOT IN {_DENIED})
 SELECT qid, chunk_id, source, page, blended, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, blend_rank) AS rank
 FROM (SELECT *, CAST({_TF} AS DOUBLE) AS rerank_score FROM d)""")
def v17(spark, sf_dir):
    """Filtered search, BM25 blend, denylist and rerank for every benchmark text over every chunk."""
    chunks = vw.stored_chunks(spark, sf_dir).filter(F.col("doc_type") != "fr")
    deny = local_table(spark, [("src3",), ("src7",)], "source string")
    out = bulk.bulk_retrieve(vw.text_queries(spark, sf_dir), chunks, deny)
    return out.select("qid", "chunk_id", "source", "page", "blended", "rerank_score", "rank")


@query("v14_retrieval_depth", """WITH u AS (SELECT conv_id, turn, lower(text) AS low, conv_id % 3 AS tier FROM conversations),
 i AS (SELECT *, CASE WHEN regexp_matches(low, 'error|exception|stack trace|failed|failure|bug|issue') THEN 'troubleshoot'
   WHEN len(list_filter(regexp_split_to_array(low, '""" + WS + """'), lambda x: x <> '')) > 20 OR regexp_matches(low, 'overview|explain|guide|walkthrough') THEN 'explore' ELSE 'lookup' END AS intent,
   CASE tier WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS tn,
   CASE tier WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 32 END AS kx, CASE tier WHEN 0 THEN 20 WHEN 1 THEN 50 ELSE 80 END AS fx FROM u)
 SELECT conv_id, turn, intent, tn AS tier, CASE intent WHEN 'lookup' THEN 4 WHEN 'troubleshoot' THEN least(kx, 8) ELSE kx END AS k_eff,
   CASE intent WHEN 'lookup' THEN greatest(10, (10 + fx) // 2) ELSE fx END AS fetch_eff FROM i""")
def v14(spark, sf_dir):
    """Depth per conversation turn from its intent and its tenant's tier."""
    from siftwell.operators import routing as rt

    t = vw.table(spark, sf_dir, "conversations").withColumn("tenant", F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")))
    tiers = local_table(spark, [("c0", "free"), ("c2", "enterprise")], "tenant string, tier string")
    rows = rt.with_limits(t.withColumn("intent", tx.classify_intent(F.col("text"))), tiers)
    return rk.retrieval_depth(rows).select("conv_id", "turn", "intent", "tier", "k_eff", "fetch_eff")


@query("s12_top_per_group", C + " SELECT qid, chunk_id, rk FROM cands")
def s12_candidates(spark, sf_dir):
    """The candidate list itself: best 25 chunks per query."""
    return candidates(spark, sf_dir).select("qid", "chunk_id", "rk")
