"""Search, scoring and reranking against brute force and small fixtures."""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions import text as tx
from siftwell.operators import bm25 as corpus
from siftwell.operators import cells as cl
from siftwell.operators import embed as em
from siftwell.operators import filters as fl
from siftwell.operators import knn as nn
from siftwell.operators import mmr as dv
from siftwell.operators import passages as ps
from siftwell.operators import ranking as rk
from siftwell.plans import bulk

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def vectors(n: int, dim: int, seed: int):
    r = np.random.default_rng(seed)
    rows = [(i, f"t{i % 3}", [float(x) for x in r.normal(size=dim).astype(np.float32)]) for i in range(n)]
    # A third of the rows are copies, so scores tie.
    return [(i, t, rows[0][2] if i % 3 == 0 else v) for i, t, v in rows]


def brute(queries, index, k, metric="cosine", match=False, skip_self=False):
    out = {}
    for qi, qt, qv in queries:
        scored = []
        for vi, vt, vv in index:
            if (match and qt is not None and qt != vt) or (skip_self and qi == vi):
                continue
            a, b = np.asarray(qv, float), np.asarray(vv, float)
            d = float(a @ b)
            if metric == "cosine":
                d = d / (np.linalg.norm(a) * np.linalg.norm(b))
            scored.append((-round(d, 6), vi))
        out[qi] = [(v, -s) for s, v in sorted(scored)[:k]]
    return out


def collected(df):
    out: dict = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["vec_id"], r["score"]))
    return out


SCHEMA_Q, SCHEMA_V = "qid long, tenant string, embedding array<float>", "vec_id long, tenant string, embedding array<float>"


@pytest.mark.parametrize("metric", ["cosine", "ip"])
@pytest.mark.parametrize("shipped", [1 << 20, 100])
def test_search_equals_brute_force_shipped_and_grid(spark, metric, shipped, monkeypatch):
    monkeypatch.setattr(nn, "CELL_QUERIES", 7)
    q, v = vectors(20, 8, 1), vectors(90, 8, 2)
    got = nn.knn(
        spark.createDataFrame(q, SCHEMA_Q), spark.createDataFrame(v, SCHEMA_V).repartition(5), 6, metric=metric, max_shipped_bytes=shipped
    )
    expected = brute(q, v, 6, metric)
    for qid, hits in collected(got).items():
        assert [h[0] for h in hits] == [h[0] for h in expected[qid]]
        assert np.allclose([h[1] for h in hits], [h[1] for h in expected[qid]], atol=1e-6)


def test_grid_with_many_small_cells(spark):
    q, v = vectors(30, 8, 3), vectors(120, 8, 4)
    dq = spark.createDataFrame(q, SCHEMA_Q).selectExpr("qid as __qid", "embedding as __qv", "0 as __cell")
    dv_ = spark.createDataFrame(v, SCHEMA_V).selectExpr("vec_id as __vid", "embedding as __vv", "0 as __cell")
    spec = nn.Spec("qid", "vec_id", 4, "cosine", (), False)
    schema = spark.createDataFrame([], "qid long, vec_id long, score double").schema
    got = collected(nn.knn_grid(dq, dv_, spec, schema, (), cell_queries=9, cell_vectors=25))
    assert {k: [x[0] for x in h] for k, h in got.items()} == {k: [x[0] for x in h] for k, h in brute(q, v, 4).items()}


def test_match_columns_null_means_no_constraint(spark):
    v = vectors(60, 6, 5)
    q = [(i, None if i % 2 else "t1", vec) for i, _, vec in vectors(10, 6, 6)]
    got = collected(nn.knn(spark.createDataFrame(q, SCHEMA_Q), spark.createDataFrame(v, SCHEMA_V), 5, match=["tenant"]))
    expected = brute(q, v, 5, match=True)
    assert {k: [x[0] for x in h] for k, h in got.items()} == {k: [x[0] for x in h] for k, h in expected.items()}


def test_unequal_lengths_and_empty_vectors_are_left_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, []), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "qid long, embedding array<float>")
    assert [r["vec_id"] for r in nn.knn(q, v, 5).orderBy("rank").collect()] == [1, 4]


def clustered(n, seed):
    return [(i, t, [x + 4 * ((i % 5) == j) for j, x in enumerate(v)]) for i, t, v in vectors(n, 8, seed)]


def test_cell_search_recall_grows_with_probes(spark, tmp_path):
    v = spark.createDataFrame(clustered(300, 7), SCHEMA_V)
    q = v.withColumnRenamed("vec_id", "qid")
    exact = collected(nn.knn(q, v, 5, exclude_self=True))
    built = cl.build_cells(v, str(tmp_path / "cells"), cells=5)
    index = cl.open_cells(spark, built.path)
    assert index.probes == built.probes and np.array_equal(index.centres, built.centres)
    recalls = []
    for probes in (1, 3, len(index.centres)):
        near = collected(cl.search_cells(q, index, 5, probes, exclude_self=True, max_shipped_bytes=1 << (12 if probes == 3 else 26)))
        recalls.append(np.mean([len({a for a, _ in exact[k]} & {a for a, _ in near.get(k, [])}) / 5 for k in exact]))
    assert recalls[0] > 0.5 and recalls == sorted(recalls) and recalls[-1] == 1.0


def test_a_query_keeps_its_best_k_only(spark):
    """What a task holds is k rows for each query, however many vectors it meets and however many cells a query probes."""
    queries = pd.DataFrame({"__qid": range(50), "__qv": [np.asarray(x[2]) for x in vectors(50, 8, 1)]})
    rows = vectors(9000, 8, 2)
    frame = pd.DataFrame({"__vid": [f"v{x[0]:05}" for x in rows], "__vv": [np.asarray(x[2]) for x in rows], "page": range(9000)})
    (best,) = nn._all_best(queries, nn.Spec("qid", "vec_id", 5, "cosine", (), False), ["page"])
    for lo in range(0, 9000, 300):
        best.meet(frame.iloc[lo : lo + 300], np.arange(50) if lo % 600 else None)
        best.merge()
        assert len(best.rows) == 250 and not best.new
    got = nn._together([best], ["qid", "vec_id", "score", "page"])
    assert [int(v[1:]) for v in got["vec_id"]] == got["page"].tolist()
    found = {q: list(zip(part["page"], part["score"])) for q, part in got.groupby("qid")}
    for q, hits in brute([(i, None, v) for i, v in zip(queries["__qid"], queries["__qv"])], rows, 5).items():
        assert [v for v, _ in found[q]] == [v for v, _ in hits]


def test_large_query_sets_meet_runs_of_cells(spark, tmp_path, monkeypatch):
    """Beyond the shipped size no task gets all queries with all their cells; a cell larger than a block is dealt to several tasks."""
    monkeypatch.setattr(nn, "CELL_QUERIES", 70)
    monkeypatch.setattr(nn, "CELL_VECTORS", 40)
    v = spark.createDataFrame(clustered(300, 7) + [(1000 + i, "t", [1.0] * 8) for i in range(90)], SCHEMA_V)
    q = v.withColumnRenamed("vec_id", "qid").drop("tenant")
    index = cl.build_cells(v, str(tmp_path / "cells"), cells=6)
    sizes = sorted((r["cell"], r["n"]) for r in index.vectors(spark).groupBy("cell").agg(F.count("*").alias("n")).collect())
    runs = cl.runs_of_cells(sizes, 40)
    assert [c for lo, hi, _ in runs for c, _ in sizes if lo <= c <= hi] == [c for c, _ in sizes]
    assert max(parts for _, _, parts in runs) > 1 and all(-(-sum(n for c, n in sizes if lo <= c <= hi) // parts) <= 40 for lo, hi, parts in runs)
    for probes in (2, len(index.centres)):
        whole, cut = (cl.search_cells(q, index, 5, probes, exclude_self=True, payload=["tenant"], max_shipped_bytes=size) for size in (1 << 26, 1 << 12))
        assert "FlatMapCoGroupsInPandas" in cut._jdf.queryExecution().toString() and "FlatMapCoGroupsInPandas" not in whole._jdf.queryExecution().toString()
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    assert collected(cut) == collected(nn.knn(q, v, 5, exclude_self=True))


def test_cell_search_reads_probed_folders_only(spark, tmp_path):
    rows = clustered(400, 9)
    index = cl.build_cells(spark.createDataFrame(rows, SCHEMA_V), str(tmp_path / "cells"))
    q = spark.createDataFrame([(1, rows[1][2])], "qid long, embedding array<float>")
    table = index.vectors(spark)
    assert table.count() == 400 and len(index.centres) >= 20
    asked = cl.nearest_cells(q.selectExpr("qid as __qid", "embedding as __qv"), index.centres, 2, "__qv").toPandas()
    cells = {int(c) for c in asked["cells"].iloc[0]}
    df = cl._search_block(asked, table, nn.Spec("qid", "vec_id", 3, "cosine", (), False), spark.createDataFrame([], "qid long, vec_id long, score double").schema, "embedding", ())
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    listed = re.search(r"PartitionFilters: \[(?:isnotnull\(cell#\d+\), )?cell#\d+ IN \(([\d,]+)\)", plan)
    assert listed, plan
    assert {int(c) for c in listed[1].split(",")} == cells and len(cells) == 2
    assert 0 < df.count() <= 3 * df.rdd.getNumPartitions()


def test_overfull_cells_are_split_and_equal_vectors_stay_together(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i, "t", [float(x) for x in (np.eye(8)[0] + 0.05 * r.normal(size=8) if i < 300 else r.normal(size=8))]) for i in range(360)]
    v = spark.createDataFrame(rows, SCHEMA_V)
    first = cl.fit_cells(v, 4)
    more = cl.split_cells(v, first, 30, 2.0, "embedding", 7)
    assert len(more) > len(first)
    sizes = [r_["n"] for r_ in cl.assigned(v, more, "embedding").groupBy("cell").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 300 and sum(sizes) == 360
    same = spark.createDataFrame([(i, "t", [1.0, 2.0]) for i in range(50)], SCHEMA_V)
    index = cl.build_cells(same, str(tmp_path / "same"))
    assert index.vectors(spark).count() == 50
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "qid long, embedding array<float>")
    assert [(x["qid"], x["vec_id"]) for x in cl.search_cells(q, index, 2).orderBy("rank").collect()] == [(1, 0), (1, 1)]
    assert cl.search_cells(q.limit(0), index, 2).count() == 0


def test_many_lists_of_one_query_merge_in_two_levels(spark):
    q, v = vectors(4, 8, 1), vectors(90, 8, 2)
    got = nn.knn(spark.createDataFrame(q, SCHEMA_Q), spark.createDataFrame(v, SCHEMA_V).repartition(17), 6)
    assert {k: [x[0] for x in h] for k, h in collected(got).items()} == {k: [x[0] for x in h] for k, h in brute(q, v, 6).items()}


def test_cosine_edge_cases(spark):
    rows = [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, e double")
    for r in df.select(sc.cosine(F.col("a"), F.col("b")).alias("c"), "e").collect():
        assert r["c"] == pytest.approx(r["e"])


def okapi(query, texts, k1=1.5, b=0.75, eps=0.25):
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf) if idf else 0.0
    idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avg)) for t in query.lower().split() if tf[t]))
    return out


def texts(n, seed):
    r = random.Random(seed)
    words = ["the"] * 8 + [f"w{i}" for i in range(30)]
    return [" ".join(r.choice(words) for _ in range(r.randrange(0, 25))) for _ in range(n)]


def test_candidate_bm25_equals_formula(spark):
    queries = {1: "the w1 w2 w1", 2: "w3 zzz The", 3: ""}
    docs = {q: texts(12, q) for q in queries}
    rows = [(q, i, queries[q], t) for q in queries for i, t in enumerate(docs[q])]
    got = rk.bm25(spark.createDataFrame(rows, "qid long, chunk_id long, query string, text string")).collect()
    assert len(got) == 36
    for r in got:
        assert r["bm25"] == pytest.approx(okapi(queries[r["qid"]], docs[r["qid"]])[r["chunk_id"]], abs=2e-6)


@pytest.mark.parametrize("layout", [{}, {"block_rows": 4, "buckets": 3, "first_blocks": 1}])
def test_corpus_bm25_equals_formula(spark, layout):
    body = texts(60, 9)
    queries = [(1, "the w1 w2"), (2, "w5 w5 w9"), (3, "nothing"), (4, "w7"), (5, ""), (6, None), (7, "the the the")]
    got: dict = {}
    df = corpus.bm25_corpus(
        spark.createDataFrame(queries, "qid long, query string"), spark.createDataFrame([*enumerate(body), (99, None)], "chunk_id long, text string").repartition(4),
        k=5, **layout,
    )
    for r in df.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["chunk_id"], r["bm25"]))
    for qid, query in queries:
        scores = sorted(((-round(s, 6), i) for i, s in enumerate(okapi(query or "", [*body, ""])) if round(s, 6)), key=lambda x: x)[:5]
        assert [h[0] for h in got.get(qid, [])] == [i for _, i in scores]
    nothing = corpus.bm25_corpus(spark.createDataFrame(queries, "qid long, query string"), spark.createDataFrame([], "chunk_id long, text string"))
    assert nothing.count() == 0


def test_blocks_that_cannot_win_are_passed_by(spark, tmp_path):
    """Two thousand chunks hold a common word once; few hold the rare one often. Blocks without those aren't scored."""
    body = [(i, "common " + "filler " * 20) for i in range(2000)] + [(5000 + i, "rare " * 9 + "common") for i in range(40)]
    index = corpus.build_postings(spark.createDataFrame(body, "chunk_id long, text string"), str(tmp_path / "ix"), block_rows=8, buckets=4)
    weights = corpus.weighted_terms(spark.createDataFrame([(1, "rare common")], "qid long, query string"), index, 4)
    bounds = weights.join(index.read(spark, "blocks"), ["bucket", "term"]).groupBy("block").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("best")).alias("b")).collect()
    got = corpus.search_postings(spark.createDataFrame([(1, "rare common")], "qid long, query string"), index, 5, buckets=4).collect()
    assert len(got) == 5 and all(r["chunk_id"] >= 5000 for r in got)
    least = min(r["bm25"] for r in got)
    assert sum(r["b"] + 1e-6 >= least for r in bounds) < 60 < len(bounds)


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_postings_move_once_whatever_stays_open(spark, tmp_path, monkeypatch, share):
    """All blocks scored in place, or the open ones only: the same hits. Building moves texts, not postings, and scores of chunks never leave their task."""
    monkeypatch.setattr(corpus, "MOSTLY_OPEN", share)
    monkeypatch.setattr(corpus, "TASK_CHUNKS", 16)
    monkeypatch.setattr(corpus, "TASK_SUMS", 500)
    body = texts(90, 5)
    index = corpus.build_postings(spark.createDataFrame(list(enumerate(body)), "chunk_id long, text string"), str(tmp_path / "ix"), block_rows=4, buckets=3)
    rows = index.read(spark, "postings")
    at = rows.withColumn("f", F.input_file_name()).groupBy("block").agg(F.countDistinct("f").alias("n"))
    assert {r["n"] for r in at.collect()} == {1} and rows.select(F.input_file_name()).distinct().count() > 2
    assert index.read(spark, "blocks").exceptAll(rows.groupBy("term", "block", "bucket").agg(F.max("impact").alias("best")).select("term", "block", "best", "bucket")).count() == 0
    assert rows.select("term", "block").distinct().count() == index.read(spark, "blocks").count()
    got = corpus.search_postings(spark.createDataFrame([(1, "the w1 w2"), (2, "w5 w5 w9")], "qid long, query string"), index, 6, buckets=3)
    moved = re.findall(r"hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert any("chunk" in m for m in moved) == (share > 1)
    for qid, query in ((1, "the w1 w2"), (2, "w5 w5 w9")):
        scores = sorted(((-round(x, 6), i) for i, x in enumerate(okapi(query, body)) if round(x, 6)))[:6]
        assert [r["chunk_id"] for r in got.filter(F.col("qid") == qid).orderBy("rank").collect()] == [i for _, i in scores]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_sums_in_arrays_are_those_of_the_joins(spark, tmp_path, monkeypatch, kind):
    """Few queries or many: the same hits, though no sum but what may win leaves the task of its block. Ids may come twice or be null."""
    monkeypatch.setattr(corpus, "MOSTLY_OPEN", 0.0)
    body = spark.createDataFrame([*enumerate(texts(150, 8)), (7, "w1 w2 w2"), (None, "w2 w1 w2 w1 w2")], "chunk_id long, text string").withColumn("chunk_id", F.col("chunk_id").cast(kind))
    queries = spark.createDataFrame([(1, "the w1 w2"), (2, "w5 w5 w9"), (3, "nothing"), (None, "w7 the"), (5, None)], "qid long, query string")
    index = corpus.build_postings(body, str(tmp_path / "ix"), block_rows=64, buckets=3)
    made = {}
    for few in (0, 100):
        monkeypatch.setattr(corpus, "FEW_QUERIES", few)
        found = corpus.search_postings(queries, index, 6, buckets=3)
        assert ("FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()) == (few > 0)
        made[few] = sorted((str(r["qid"]), r["rank"], str(r["chunk_id"]), r["bm25"]) for r in found.collect())
    assert made[0] == made[100] and len(made[0]) == 18 and any(r[2] == "None" for r in made[0])
    sums, weights = [], corpus.weighted_terms(queries, index, 3)
    known = spark.createDataFrame([(1, 2.0)], "qid long, least double")
    postings = index.read(spark, "postings").join(weights.select("term").distinct(), "term").withColumn("term", F.xxhash64("term"))
    sums = corpus.scored_in_arrays(weights.withColumn("term", F.xxhash64("term")), postings, known, 6, 1, 64)
    first = [r["bm25"] for r in sums.filter("qid = 1").collect()]
    assert 6 <= len(first) < 60 and min(first) >= 1.99


def test_the_index_is_read_once_for_a_search(spark, tmp_path, monkeypatch):
    index = corpus.build_postings(spark.createDataFrame(list(enumerate(texts(90, 5))), "chunk_id long, text string"), str(tmp_path / "ix"), block_rows=4, buckets=3)
    real, asked = corpus.Postings.read, []
    monkeypatch.setattr(corpus.Postings, "read", lambda self, spark, name: asked.append(name) or real(self, spark, name))
    found = corpus.search_postings(spark.createDataFrame([(1, "the w1 w2")], "qid long, query string"), index, 6, buckets=3)
    assert sorted(asked) == ["postings", "terms"] and str(tmp_path / "ix") not in "".join(found.inputFiles())


def test_term_counts_are_those_of_the_tokens(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "b", "a", "c", "a"]), (2, 0, []), (3, 1, ["x"])], "chunk long, block long, toks array<string>")
    got = corpus.term_counts(rows.select("chunk", "block", F.array_sort("toks").alias("toks"))).collect()
    assert sorted((r["chunk"], r["block"], r["dl"], r["term"], r["tf"]) for r in got) == [(1, 0, 5, "a", 3), (1, 0, 5, "b", 1), (1, 0, 5, "c", 1), (3, 1, 1, "x", 1)]


def test_twenty_thousand_queries_need_no_matrix(spark):
    body = texts(300, 4)
    queries = spark.range(20_000).select(F.col("id").alias("qid"), F.concat_ws(" ", F.concat(F.lit("w"), (F.col("id") % 30).cast("string")), F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("query"))
    found = corpus.bm25_corpus(queries, spark.createDataFrame(list(enumerate(body)), "chunk_id long, text string"), k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    by_query = {r["qid"]: r["best"] for r in found.filter("rank = 1").select("qid", F.col("chunk_id").alias("best")).collect()}
    for qid in range(0, 20_000, 997):
        scores = okapi(f"w{qid % 30} w{qid % 7}", body)
        assert by_query[qid] == max(range(300), key=lambda i: (round(scores[i], 6), -i))


def cands(spark, rows):
    return spark.createDataFrame(rows, "qid long, chunk_id long, query string, text string, distance double, source string, page int, rk int")


def test_hybrid_prefers_more_term_hits(spark):
    rows = [(1, 1, "engine", "engine engine engine", 0.6, "a", 1, 1), (1, 2, "engine", "engine", 0.55, "b", 1, 2)]
    got = rk.hybrid_tf(cands(spark, rows), alpha=0.5, k=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2]
    assert got[0]["tf"] == 3.0 and got[1]["v_sim"] == pytest.approx(0.05 / 0.3)


def test_term_frequency_counts_substrings_and_repeats(spark):
    row = spark.createDataFrame([("Thrust thrust on", "thrusters Thrust on on")], "q string, t string")
    assert row.select(tx.tf_score(F.col("q"), F.col("t"))).first()[0] == 2 + 2 + 2
    assert spark.createDataFrame([("  ", "x")], "q string, t string").select(tx.tf_score(F.col("q"), F.col("t"))).first()[0] == 0.0


def test_rerank_orders_caps_and_uses_a_scorer(spark):
    rows = [(1, 1, "engine throttle", "engine engine throttle control", 0.1, "a", 1, 2), (1, 2, "engine throttle", "engine control", 0.1, "b", 1, 1)]
    assert [r["chunk_id"] for r in rk.rerank_capped(cands(spark, rows), 10).orderBy("rank").collect()] == [1, 2]
    many = [(1, i, "thrust", "thrust " * i, 0.1, "s", i, i) for i in range(1, 15)]
    assert [r["chunk_id"] for r in rk.rerank_capped(cands(spark, many), cap=10).orderBy("rank").collect()] == list(range(10, 0, -1))
    assert rk.rerank(cands(spark, many), top_k=3).count() == 3
    shortest = rk.rerank(cands(spark, many), lambda q, t: -t.str.len(), top_k=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in shortest] == [1, 2]


def scored(spark, n=40, seed=3):
    r = random.Random(seed)
    rows = [(q, i, f"s{r.randrange(4)}", r.randrange(3), i, r.random(), r.choice([0.0, r.random() * 5])) for q in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "qid long, chunk_id long, source string, page int, rk int, v_sim double, bm25 double")


def test_one_pass_blend_equals_the_steps(spark):
    df = scored(spark)
    both = rk.blend(df, df, k=6)
    steps = {(r["qid"], r["source"], r["page"], r["blended"], r["rank"], r["chunk_id"]) for r in rk.best_chunk_per_key(both, df, 6).collect()}
    one = {(r["qid"], r["source"], r["page"], r["blended"], r["blend_rank"], r["chunk_id"]) for r in rk.blend_chunks(df, k=6).collect()}
    assert steps == one and len(one) == 18
    apart = rk.blend(df, df.select("*"), k=6)
    assert {tuple(r) for r in apart.select("qid", "source", "page", "blended").collect()} == {x[:4] for x in one}


def test_blend_of_unique_pages_stays_between_zero_and_one(spark):
    df = scored(spark).withColumn("source", F.col("chunk_id").cast("string"))
    values = [r["blended"] for r in rk.blend(df, df, k=100).collect()]
    assert len(values) == 120 and 0 <= min(values) and max(values) <= 1


def test_weight_table_overrides_defaults(spark):
    df = scored(spark)
    table = spark.createDataFrame([("dense", 1.0), ("bm25", 0.0)], "name string, weight double")
    a = rk.blend(df, df, table, k=4).select("qid", "source", "page", "blended").collect()
    b = rk.blend(df, df, {"dense": 1.0, "bm25": 0.0}, k=4).select("qid", "source", "page", "blended").collect()
    assert sorted(a) == sorted(b)


def test_equal_distances_give_full_similarity(spark):
    rows = [(1, i, "q", "t", 0.4, "a", 1, i) for i in range(3)]
    assert {r["v_sim"] for r in rk.dist_to_sim(cands(spark, rows)).collect()} == {1.0}


def test_confidence_parts(spark):
    answers = spark.createDataFrame([(1, 5, "x" * 400, True), (2, 1, "", False)], "qid long, n_docs int, answer string, rerank_enabled boolean")
    blended = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.4), (2, 1, 0.9)], "qid long, rank int, blended double")
    got = {r["qid"]: r["confidence"] for r in rk.confidence(answers, blended).collect()}
    assert got == {1: pytest.approx(0.2 + 0.2 + 0.2 + 0.2), 2: pytest.approx(0.04)}


def greedy(rows, k, lam):
    left, taken = list(rows), []
    unit = {c: np.asarray(v) / np.linalg.norm(v) for c, _, v in rows}
    while left and len(taken) < k:
        best = max(left, key=lambda x: (round(x[1] if not taken else lam * x[1] - (1 - lam) * max(unit[x[0]] @ unit[t[0]] for t in taken), 6), -x[0]))
        taken.append(best)
        left.remove(best)
    return [t[0] for t in taken]


def test_diversified_pick_equals_greedy(spark):
    r = np.random.default_rng(11)
    rows = [(q, i, float(r.random()), [float(x) for x in r.normal(size=4)]) for q in range(4) for i in range(15)] + [(9, 1, 0.5, [1.0, 0.0, 0.0, 0.0])]
    df = dv.mmr(spark.createDataFrame(rows, "qid long, chunk_id long, score double, embedding array<double>"), 5, 0.6)
    for q in (0, 1, 2, 3, 9):
        mine = [x["chunk_id"] for x in df.filter(F.col("qid") == q).orderBy("rank").collect()]
        assert mine == greedy([(c, s, v) for g, c, s, v in rows if g == q], 5, 0.6)


def test_diversified_pick_from_fifty_thousand(spark):
    r = np.random.default_rng(12)
    vectors_, scores = r.normal(size=(50_000, 4)), r.random(50_000)
    rows = [(1, i, float(s), v) for i, (s, v) in enumerate(zip(scores, vectors_.tolist(), strict=True))]
    df = dv.mmr(spark.createDataFrame(rows, "qid long, chunk_id long, score double, embedding array<double>").repartition(8), 4, 0.5)
    unit = vectors_ / np.linalg.norm(vectors_, axis=1, keepdims=True)
    taken = [int(np.argmax(np.round(scores, 6)))]
    while len(taken) < 4:
        gain = np.round(0.5 * scores - 0.5 * (unit @ unit[taken].T).max(axis=1), 6)
        gain[taken] = -9
        taken.append(int(np.argmax(gain)))
    assert [x["chunk_id"] for x in df.orderBy("rank").collect()] == taken


def test_passages_found_verbatim(spark, monkeypatch):
    docs = [(i, f"s{i % 2}", t) for i, t in enumerate(["xx alpha beta yy", "alpha betA", "gammaalpha beta", "", None, "delta"])]
    items = [(1, "alpha beta"), (2, "delta"), (3, "zzz"), (4, "alpha beta"), (5, ""), (6, None)]
    expected = {(0, 1), (0, 4), (2, 1), (2, 4), (5, 2)}

    def found(docs, items):
        df = ps.find_passages(
            spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id", ["source"]
        )
        return sorted((r["doc_id"], r["source"], r["item_id"]) for r in df.collect())

    assert {(d, i) for d, _, i in found(docs, items)} == expected
    assert found(docs, items[4:]) == found([], items) == []
    # Few letters, so that blocks and parts of passages repeat everywhere; also overlapping ones, and two documents of one id.
    rng = random.Random(5)
    body = ["".join(rng.choice("abé ") for _ in range(rng.choice([3, 40, 900]))) for _ in range(60)]
    docs = [(i % 50, "s", t) for i, t in enumerate(body)] + [(77, "s", "ab" * 300), (78, "s", "x" * 16 + "y" * 17)]
    texts_ = [t[a : a + n] for t in body for a, n in [(rng.randrange(len(t)), rng.choice([1, 5, 15, 16, 17, 31, 32, 33, 100]))]] + ["ab" * 20, "ab" * 400, "x" * 16 + "y" * 16, "y" * 16 + "x" * 16]
    items = list(enumerate(texts_))
    by_hand = sorted((d, s, i) for d, s, t in docs for i, p in items if p in t)
    assert len(by_hand) > 100 and found(docs, items) == by_hand
    # A table that is far too small lets windows pass by mistake; the join keeps the result right.
    monkeypatch.setattr(ps, "LEAST_BITS", 64)
    monkeypatch.setattr(ps, "MOST_BITS", 64)
    assert found(docs, items) == by_hand


def test_bulk_retrieval_end_to_end(spark):
    chunks = spark.createDataFrame(
        [(1, "a", 1, "en", "engine throttle control manual"), (2, "b", 1, "en", "engine oil"), (3, "c", 2, "en", "wing loading tables"), (4, "d", 1, "fr", "engine throttle control manual")],
        "chunk_id long, source string, page int, doc_type string, text string",
    )
    queries = spark.createDataFrame([(1, "engine throttle"), (2, "wing loading")], "qid long, query string")
    deny = spark.createDataFrame([("b",)], "source string")
    got = bulk.bulk_retrieve(queries, chunks, deny, fl.Filters(doc_type="en")).collect()
    first = {r["qid"]: r["source"] for r in got if r["rank"] == 1}
    assert first == {1: "a", 2: "c"} and not {r["source"] for r in got} & {"b", "d"}


def test_only_texts_go_to_the_embedder(spark):
    df = spark.createDataFrame([(1, "a b A", b"xyz"), (2, None, None)], "id long, text string, other binary")
    for made in (em.embed(df), em.embed_safely(df, em.HashedCounts())):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
        assert [(r["id"], r["other"], sum(r["embedding"])) for r in made.orderBy("id").collect()] == [(1, bytearray(b"xyz"), 3.0), (2, None, 0.0)]


def test_embedder_counts_hashed_tokens(spark):
    df = em.embed(spark.createDataFrame([(1, "a b A"), (2, None), (3, "")], "id long, text string"), em.HashedCounts(16))
    got = {r["id"]: r["embedding"] for r in df.collect()}
    assert sum(got[1]) == 3 and got[1][em.token_bucket("a", 16)] >= 2 and sum(got[2]) == sum(got[3]) == 0


def test_metadata_filters(spark):
    rows = [("ok.pdf", "spec", "2022-06-01"), ("ok.pdf", "spec", "2023-01-01"), ("no.pdf", "spec", "2022-06-01"), ("ok.pdf", "memo", "2022-06-01"), ("ok.pdf", "spec", None), ("ok.pdf", "spec", "soon")]
    df = spark.createDataFrame(rows, "source string, doc_type string, date string")
    f = fl.Filters(["ok.pdf"], "spec", "2022-01-01", "2022-12-31")
    assert [tuple(r) for r in fl.apply_filters(df, f).collect()] == [rows[0]]
    assert fl.apply_filters(df, fl.Filters()).count() == 6


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "x", 1, "long text")], "source string, tenant string, page int, text string").write.partitionBy("tenant").parquet(path)
    df = fl.apply_filters(spark.read.parquet(path), fl.Filters(sources=["a", "b"], tenant="x")).select("source", "page")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan and "PushedFilters: [In(source" in plan and "text" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("shipped", [1 << 20, 0])
def test_vectors_of_several_lengths_meet_their_own_kind(spark, shipped):
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0, 1.0])], "qid long, embedding array<double>")
    index = spark.createDataFrame([(10, [1.0, 0.1, 0.0]), (11, [0.2, 1.0]), (12, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in nn.knn(queries, index, 2, max_shipped_bytes=shipped).collect()}
    assert got == {(1, 1): 10, (2, 1): 11, (2, 2): 12, (3, 1): 10}


def test_candidates_from_a_stored_index_equal_those_embedded_on_the_way(spark):
    chunks = spark.createDataFrame([(i, f"s{i % 3}", i, f"wing load {i} " + "stall " * (i % 4)) for i in range(30)], "chunk_id long, source string, page int, text string")
    queries = spark.createDataFrame([(1, "wing stall"), (2, "load 7")], "qid long, query string")
    plain = bulk.text_candidates(queries, chunks, 5)
    stored = bulk.text_candidates(queries, em.embed(chunks), 5)
    columns = ["qid", "chunk_id", "score", "rk", "text"]
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, stored.select(columns).collect()))
    assert stored.columns == plain.columns


class Moody:
    """Refuses every first call in a process, and always texts that hold a word."""

    def __init__(self):
        self.calls = 0

    def __call__(self, texts):
        self.calls += 1
        if self.calls == 1 or any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]


def test_embedding_tries_again_and_reembedding_skips(spark):
    rows = spark.createDataFrame([(i, "good" * (i + 1)) for i in range(5)], "id long, text string").coalesce(1)
    assert sorted(r["embedding"][0] for r in em.embed(rows, Moody(), pause=0.01).collect()) == [4.0, 8.0, 12.0, 16.0, 20.0]
    with pytest.raises(Exception, match="refused"):
        em.embed(rows.withColumn("text", F.lit("bad")), Moody(), pause=0.01).collect()
    mixed = rows.unionByName(spark.createDataFrame([(8, "bad"), (9, "")], "id long, text string")).coalesce(1)
    built, failed = em.reembed(mixed, Moody())
    assert {r["id"] for r in built.collect()} == set(range(5)) and [(r["id"], r["error"]) for r in failed.collect()] == [(8, "ValueError: refused")]
    assert tuple(em.build_record(built, failed, "p", "m").first()) == ("p", "m", 5, 1)
