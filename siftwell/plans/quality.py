"""Registered evaluation, governance and text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions import text as tx
from siftwell.operators import evaluation as ev
from siftwell.operators import filters as fl
from siftwell.operators import governance as gv
from siftwell.operators import passages as ps
from siftwell.operators import ranking as rk
from siftwell.operators import usage as us
from siftwell.plans import ingesting as ing
from siftwell.plans import retrieval as rq
from siftwell.plans import usage as uq
from siftwell.plans import views as vw
from siftwell.plans.registry import query
from siftwell.session import local_table, materialize, spread
from siftwell.sources import tables as tb

DOCS, LOG, WS = "WITH " + vw.SQL_DOCUMENTS, "WITH " + vw.SQL_LOG, vw._WS_SQL

# ---- evaluation --------------------------------------------------------------------------------------

_GOLD = rq.C + f""", gold AS (SELECT qid AS query_id, CASE qid % 4 WHEN 0 THEN '' ELSE 't' || (qid % 4) END AS tenant, query, parts[1] AS p1, parts[3] AS p3, len(parts) AS np, qid FROM (SELECT *, {rq._TOKENS % 'query'} AS parts FROM tq)),
  exp AS (SELECT item_id AS query_id, list(DISTINCT d.source) AS expected FROM benchmark b JOIN docs d ON contains(d.text, b.text) GROUP BY item_id),
  res AS (SELECT qid AS query_id, list(source ORDER BY rk) AS sources, any_value(text) FILTER (rk = 1) AS answer, CASE WHEN qid % 11 = 0 THEN 'timeout' END AS error FROM cands WHERE rk <= 5 GROUP BY qid),
  er AS (SELECT g.query_id, CASE WHEN g.tenant = '' THEN '__default__' ELSE g.tenant END AS tenant, CASE g.query_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'spec' ELSE 'other' END AS doc_type, r.query_id IS NOT NULL AND r.error IS NULL AS ran,
     CASE WHEN r.query_id IS NOT NULL AND r.error IS NULL AND coalesce(list_has_any(e.expected, r.sources), false) THEN 1 ELSE 0 END AS hit,
     CASE WHEN r.query_id IS NOT NULL AND r.error IS NULL THEN (CASE WHEN contains(lower(answer), p1) THEN 1 ELSE 0 END + CASE WHEN contains(lower(answer), p3) THEN 1 ELSE 0 END) / 3.0 ELSE 0.0 END AS answer_score
   FROM gold g LEFT JOIN exp e USING (query_id) LEFT JOIN res r USING (query_id))"""


def golden(spark, sf_dir):
    """Benchmark texts as questions; the sources that contain them verbatim are expected."""
    items = vw.table(spark, sf_dir, "benchmark")
    docs = vw.texts(spark, sf_dir)
    found = ps.find_passages(docs, items, "doc_id", "item_id", ["source"])
    # At most one entry per (item, source) reaches the list.
    expected = found.select("item_id", "source").distinct().groupBy("item_id").agg(F.collect_list("source").alias("expected_sources"))
    parts = tx.tokens(F.col("text"))
    tenant = F.when(F.col("item_id") % 4 == 0, "").otherwise(vw.tenant_of("item_id"))
    return items.join(expected, "item_id", "left").select(
        F.col("item_id").alias("query_id"), tenant.alias("tenant"), F.col("text").alias("query"), "expected_sources",
        F.array(parts[0], parts[2], F.lit("zzz")).alias("expected_answer_contains"),
        F.when(F.col("item_id") % 3 == 0, "manual").when(F.col("item_id") % 3 == 1, " spec\t").alias("expected_doc_type"),
        F.when(F.col("item_id") % 5 != 0, F.array(parts[1], parts[3])).alias("keywords"),
    )


def results(spark, sf_dir, order="rk"):
    """Five best sources and the best chunk per question; some questions failed."""
    c = rq.candidates(spark, sf_dir)
    best = rk.top(c, 5, [order, "chunk_id"], out="__r") if order != "rk" else c.filter("rk <= 5").withColumn("__r", F.col("rk"))
    rows = best.groupBy(F.col("qid").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__r", "source"))), lambda s: s["source"]).alias("sources"),
        F.min_by("text", "__r").alias("answer"),
    )
    return rows.withColumn("error", F.when(F.col("query_id") % 11 == 0, "timeout"))


def eval_rows(spark, sf_dir):
    return ev.eval_rows(golden(spark, sf_dir), results(spark, sf_dir))


@query("a2_offline_eval", _GOLD + " SELECT count(*) AS total, round(sum(hit) / count(*), 6) AS recall_at_k, round(sum(answer_score) / count(*), 6) AS avg_answer_contains FROM er")
def a2(spark, sf_dir):
    out = ev.offline_eval(eval_rows(spark, sf_dir))
    return out.withColumn("recall_at_k", F.round("recall_at_k", 6)).withColumn("avg_answer_contains", F.round("avg_answer_contains", 6))


@query("a3_offline_eval_slices", _GOLD + """ SELECT CASE WHEN grouping(tenant) = 0 THEN 'tenant' ELSE 'doc_type' END AS slice_type, CASE WHEN grouping(tenant) = 0 THEN tenant ELSE doc_type END AS slice_key, count(*) AS n,
   round(avg(hit), 6) AS recall_at_k, round(avg(answer_score), 6) AS avg_answer_contains FROM (SELECT * FROM er WHERE ran) GROUP BY GROUPING SETS ((tenant), (doc_type))""")
def a3(spark, sf_dir):
    out = ev.offline_eval_slices(eval_rows(spark, sf_dir))
    return out.withColumn("recall_at_k", F.round("recall_at_k", 6)).withColumn("avg_answer_contains", F.round("avg_answer_contains", 6))


@query("a4_harness_eval", _GOLD + f""", kw AS (SELECT g.query_id, CASE WHEN answer IS NOT NULL AND coalesce(list_has_any(expected, sources[1:3]), false) THEN 1.0 ELSE 0.0 END AS r,
     CASE WHEN answer IS NULL THEN 0.0 WHEN g.query_id % 5 = 0 THEN 1.0 ELSE (CASE WHEN contains(lower(answer), k.ks[2]) THEN 1 ELSE 0 END + CASE WHEN contains(lower(answer), k.ks[4]) THEN 1 ELSE 0 END) / 2.0 END AS w
   FROM gold g JOIN (SELECT qid AS query_id, {rq._TOKENS % 'query'} AS ks FROM tq) k USING (query_id) LEFT JOIN exp USING (query_id) LEFT JOIN res USING (query_id))
   SELECT count(*) AS n, round(avg(r), 6) AS avg_recall, round(avg(w), 6) AS avg_keyword_hit FROM kw""")
def a4(spark, sf_dir):
    out = ev.harness_eval(golden(spark, sf_dir), results(spark, sf_dir))
    return out.withColumn("avg_recall", F.round("avg_recall", 6)).withColumn("avg_keyword_hit", F.round("avg_keyword_hit", 6))


@query("a2_golden_sources", _GOLD + " SELECT query_id, array_to_string(list_sort(expected), ',') AS expected FROM exp")
def a2_golden(spark, sf_dir):
    """Documents' sources holding each benchmark text verbatim."""
    g = golden(spark, sf_dir).filter(F.col("expected_sources").isNotNull())
    return g.select("query_id", F.array_join(F.sort_array("expected_sources"), ",").alias("expected"))


_JUDGE = "WITH " + vw.SQL_JUDGE


def _drift(where: str, group: str, cols: str) -> str:
    return f"""SELECT {cols} count(*) AS total, count(*) FILTER (winner = 'control') AS control_wins, count(*) FILTER (winner = 'treatment') AS treatment_wins, count(*) FILTER (winner = 'tie') AS ties, round(avg(treatment_score - control_score), 6) AS avg_delta,
      CASE WHEN count(*) >= 10 AND round(avg(treatment_score - control_score), 6) < -0.05 THEN 'regressed' WHEN count(*) >= 10 AND round(avg(treatment_score - control_score), 6) > 0.05 THEN 'improved' ELSE 'stable' END AS status
      FROM judged WHERE {where} {group}"""


@query("a6_drift_status", f"{_JUDGE} {_drift(f'''epoch_us(TIMESTAMP '{uq.AS_OF}') // 1000000 - epoch_us(ts) // 1000000 BETWEEN 0 AND 432000''', 'GROUP BY tenant', 'tenant,')}")
def a6(spark, sf_dir):
    return ev.drift_status(vw.judge(spark, sf_dir), uq.as_of(), 432000, "*")


@query("a6_drift_overall", f"{_JUDGE} {_drift('true', '', '')}")
def a6_all(spark, sf_dir):
    return ev.drift_status(vw.judge(spark, sf_dir), uq.as_of(), 0)


@query("a7_judge_rows", _JUDGE + """ SELECT request_id, CASE WHEN request_id % 5 = 0 THEN 0.0 ELSE control_score END AS control_score, CASE WHEN request_id % 5 IN (0, 1) THEN 0.0 ELSE treatment_score END AS treatment_score,
   CASE request_id % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'tie' WHEN 2 THEN CASE WHEN abs(treatment_score - control_score) < 0.05 THEN 'tie' WHEN treatment_score > control_score THEN 'treatment' ELSE 'control' END ELSE winner END AS winner FROM judged""")
def a7(spark, sf_dir):
    """Replies of several shapes: no JSON, a missing score, an unknown winner, an upper-case winner."""
    j = vw.judge(spark, sf_dir)
    m = F.col("request_id") % 5
    full = F.to_json(F.struct("control_score", "treatment_score", F.when(m == 2, F.lit("nobody")).otherwise(F.upper("winner")).alias("winner")))
    part = F.to_json(F.struct("control_score"))
    reply = F.when(m == 0, "no verdict").when(m == 1, F.concat(F.lit("Sure:\n"), part)).otherwise(F.concat(F.lit("Verdict: "), full, F.lit("\nthanks")))
    raw = j.select("request_id", reply.alias("reply"))
    return ev.normalise_judge(raw).select("request_id", "control_score", "treatment_score", "winner")


_SHADOW = rq.C + rq._SIM + rq._BM + """, ctl AS (SELECT qid, list(source ORDER BY rk) AS s FROM lex WHERE rk <= 5 GROUP BY qid),
   tr AS (SELECT qid, list(source ORDER BY br) AS s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, chunk_id) AS br FROM lex) WHERE br <= 5 GROUP BY qid)"""


def runs(spark, sf_dir):
    """Every question answered twice: by vector order (control) and by BM25 order (treatment)."""
    scored = materialize(rk.bm25(rq.candidates(spark, sf_dir)), "scored")
    w = rk.top(scored, 5, ["rk"], out="__r").withColumn("bucket", F.lit("control"))
    t = rk.top(scored, 5, [F.col("bm25").desc(), "chunk_id"], out="__r").withColumn("bucket", F.lit("treatment"))
    both = w.unionByName(t).groupBy("qid", "bucket").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__r", "source"))), lambda s: s["source"]).alias("sources")
    )
    control = F.col("bucket") == "control"
    return both.select(
        F.col("qid").alias("query_id"), vw.tenant_of("qid").alias("tenant"), "bucket",
        F.when(control, "large").otherwise("small").alias("model"), (~control).alias("rerank"),
        F.when(F.col("qid") % 7 != 0, F.concat(F.col("bucket"), F.lit(" answer"))).alias("result"), "sources",
        F.when((F.col("qid") % 7 == 0), F.lit("timeout")).alias("error"),
        F.when(control, 0.1 + (F.col("qid") % 9) / 100.0).otherwise(0.1 + (F.col("qid") % 10) / 100.0).alias("latency_s"),
    )


@query("a8_shadow_pairs", _SHADOW + """ SELECT qid AS query_id, array_to_string(ctl.s, ',') AS control_sources, array_to_string(tr.s, ',') AS treatment_sources, CASE WHEN qid % 7 <> 0 THEN 'control answer' END AS control_result,
   CASE WHEN qid % 7 <> 0 THEN 'treatment answer' END AS treatment_result, CASE WHEN qid % 7 = 0 THEN 'timeout' END AS treatment_error FROM ctl JOIN tr USING (qid)""")
def a8(spark, sf_dir):
    p = ev.shadow_pairs(runs(spark, sf_dir))
    return p.select(
        "query_id", F.array_join("control.sources", ",").alias("control_sources"), F.array_join("treatment.sources", ",").alias("treatment_sources"),
        F.col("control.result").alias("control_result"), F.col("treatment.result").alias("treatment_result"), F.col("treatment.error").alias("treatment_error"),
    )


_LATS = """, lt AS (SELECT qid, 0.1 + (qid % 9) / 100.0 AS ca, 0.1 + (qid % 10) / 100.0 AS ta FROM ctl WHERE qid % 7 <> 0),
   pq AS (SELECT max(v) FILTER (c = 'control' AND i = round_even(0.95 * (n - 1), 0)) AS pa, max(v) FILTER (c = 'treatment' AND i = round_even(0.95 * (n - 1), 0)) AS pc, max(v) FILTER (c = 'control' AND i = round_even(0.5 * (n - 1), 0)) AS ma, max(v) FILTER (c = 'treatment' AND i = round_even(0.5 * (n - 1), 0)) AS mc, max(n) AS n
     FROM (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY c) AS n FROM (SELECT 'control' AS c, ca AS v FROM lt UNION ALL SELECT 'treatment', ta FROM lt)))"""


@query("a15_index_latency", _SHADOW + _LATS + " SELECT 'control' AS collection, round(CAST(ma AS DOUBLE), 6) AS p50, round(CAST(pa AS DOUBLE), 6) AS p95, n FROM pq UNION ALL SELECT 'treatment', round(CAST(mc AS DOUBLE), 6), round(CAST(pc AS DOUBLE), 6), n FROM pq")
def a15(spark, sf_dir):
    out = ev.measure_index(runs(spark, sf_dir).withColumnRenamed("bucket", "collection"))
    return out.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query("a16_canary_gate", _SHADOW + _LATS + """, j AS (SELECT avg(CASE WHEN qid % 7 = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(ctl.s), list_distinct(tr.s))) / greatest(1, len(list_distinct(list_concat(ctl.s, tr.s)))) END) AS ov FROM ctl JOIN tr USING (qid))
   SELECT round(CAST(pa AS DOUBLE), 6) AS p95_active, round(CAST(pc AS DOUBLE), 6) AS p95_canary, round(CAST((pc - pa) / greatest(0.000001, pa) * 100 AS DOUBLE), 6) AS latency_increase_pct, round(ov, 6) AS avg_source_overlap, (pc - pa) / greatest(0.000001, pa) * 100 <= 20 AND ov >= 0.8 AS pass FROM pq, j""")
def a16(spark, sf_dir):
    r = materialize(runs(spark, sf_dir), "runs")
    out = ev.canary_gate(r.filter("bucket = 'control'"), r.filter("bucket = 'treatment'"))
    for c in ("p95_active", "p95_canary", "latency_increase_pct", "avg_source_overlap"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("j6_run_pairs", _SHADOW + """ SELECT qid AS query_id, CASE WHEN qid % 7 = 0 THEN 0 ELSE len(list_intersect(list_distinct(ctl.s), list_distinct(tr.s))) END AS shared,
   CASE WHEN qid % 7 = 0 THEN 0 ELSE len(list_distinct(list_concat(ctl.s, tr.s))) END AS together FROM ctl JOIN tr USING (qid)""")
def j6(spark, sf_dir):
    r = ev.query_sources(materialize(runs(spark, sf_dir), "runs"))
    a = r.filter("bucket = 'control'").select("query_id", F.col("source_set").alias("a"))
    b = r.filter("bucket = 'treatment'").select("query_id", F.col("source_set").alias("b"))
    return a.join(b, "query_id").select(
        "query_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_union("a", "b")).cast("long").alias("together")
    )


@query("a28_eval_history", LOG + """, r AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS run_id, round(avg(CASE WHEN status = 200 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(CASE WHEN answer_chars > 400 THEN 1.0 ELSE 0.0 END), 6) AS avg_answer_contains FROM log GROUP BY ALL),
   k AS (SELECT * FROM r ORDER BY run_id DESC LIMIT 20)
   SELECT run_id, recall_at_k, avg_answer_contains, round(recall_at_k - lag(recall_at_k) OVER (ORDER BY run_id), 6) AS recall_delta, round(avg_answer_contains - lag(avg_answer_contains) OVER (ORDER BY run_id), 6) AS answer_delta FROM k""")
def a28(spark, sf_dir):
    """One run per day, with success share as recall."""
    log = vw.request_log(spark, sf_dir)
    day = F.floor(F.unix_micros("ts") / 86400000000).cast("long")
    daily = log.groupBy(day.alias("run_id")).agg(
        F.round(F.avg(F.when(F.col("status") == 200, 1.0).otherwise(0.0)), 6).alias("recall_at_k"),
        F.round(F.avg(F.when(F.col("answer_chars") > 400, 1.0).otherwise(0.0)), 6).alias("avg_answer_contains"),
    ).withColumn("ts", F.col("run_id"))
    out = ev.eval_history(daily).drop("ts")
    return out.withColumn("recall_delta", F.round("recall_delta", 6)).withColumn("answer_delta", F.round("answer_delta", 6))


# ---- governance --------------------------------------------------------------------------------------

# The SQL engine's word boundary knows ASCII only: the tables' other letters are spelled out before the patterns with
# boundaries run, and put back afterwards.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = [(c, f"qzx{chr(97 + i)}xzq") for i, c in enumerate(_LETTERS)]


def _email(col: str, word: str = "REDACTED") -> str:
    return f"regexp_replace({col}, '{tx.EMAIL}', '[{word}_EMAIL]', 'g')"


def _spelled(col: str) -> str:
    for letter, code in _CODES:
        col = f"replace({col}, '{letter}', '{code}')"
    return col


def _unspelled(col: str) -> str:
    for letter, code in _CODES:
        col = f"replace({col}, '{code}', '{letter}')"
    return col


def _phone(col: str, word: str = "REDACTED") -> str:
    return f"regexp_replace({col}, '{tx.PHONE}', '[{word}_PHONE]', 'g')"


def _pii(col: str) -> str:
    phones = _phone(_spelled(_email(col)))
    return _unspelled(f"regexp_replace({phones}, '{tx.ID}', '[REDACTED_ID]', 'g')")


def _contacts(col: str, word: str = "REDACTED") -> str:
    return _unspelled(_phone(_spelled(_email(col, word)), word))


def _secrets(col: str) -> str:
    a, b = tx.SECRET.replace("'", "''"), tx.PASSWORD.replace("'", "''")
    return f"regexp_replace(regexp_replace({col}, '{a}', '\\1: [REDACTED_SECRET]', 'g'), '{b}', '\\1: [REDACTED_SECRET]', 'g')"


@query("x1_redacted_pii", DOCS + f" SELECT doc_id, {_pii('text')} AS redacted FROM docs")
def x1(spark, sf_dir):
    return vw.texts(spark, sf_dir).select("doc_id", tx.redact_pii(F.col("text")).alias("redacted"))


@query("x3_redacted_secrets", DOCS + f" SELECT doc_id, {_secrets('text')} AS redacted FROM docs")
def x3(spark, sf_dir):
    return vw.texts(spark, sf_dir).select("doc_id", tx.redact_secrets(F.col("text")).alias("redacted"))


_POLICIES = [
    ("t0", ["src1", "src2"], ["de", "en"], ["eu"], "deny", True), ("t1", [], [], [], "mask", False), ("t2", None, ["fr"], None, "allow", False),
]
_POLICY_SCHEMA = "tenant string, allowed_sources array<string>, allowed_doc_types array<string>, residency array<string>, pii_tier string, break_glass boolean"


def policies(spark):
    return local_table(spark, _POLICIES, _POLICY_SCHEMA)


_DECISION = "CASE WHEN tenant = 't0' AND doc_id % 8 = 0 THEN 'overridden' WHEN tenant = 't0' THEN 'denied' WHEN tenant = 't1' THEN 'masked' WHEN tenant = 't2' THEN 'allowed' ELSE 'redacted' END"
_POST = f"""CASE {_DECISION} WHEN 'denied' THEN '' WHEN 'masked' THEN {_contacts('text', 'MASKED')} WHEN 'redacted' THEN {_contacts('text')} ELSE text END"""
_POST_SOURCES = f"CASE {_DECISION} WHEN 'denied' THEN '' WHEN 'masked' THEN '[MASKED_SOURCE],[MASKED_SOURCE]' ELSE source || ',src0' END"


def answers(spark, sf_dir):
    """Every document as an answer with two cited sources."""
    d = F.col("doc_id")
    pages = F.array(
        F.struct(F.col("source"), F.when(d % 3 != 0, (d % 9).cast("int")).alias("page")), F.struct(F.lit("src0").alias("source"), F.lit(1).alias("page"))
    )
    return vw.texts(spark, sf_dir).select(
        "doc_id", "tenant", "doc_type", F.lit(None).cast("string").alias("region"), F.col("text").alias("answer"), pages.alias("sources"),
        (d % 8 == 0).alias("override"), F.concat(F.lit("question "), d.cast("string")).alias("query"), F.timestamp_seconds(F.lit(1704067200) + d).alias("ts"),
    )


@query("x2_policy_answers", DOCS + f" SELECT doc_id, {_DECISION} AS decision, {_POST} AS post_answer, {_POST_SOURCES} AS post_sources FROM docs")
def x2(spark, sf_dir):
    done = gv.policy_post(gv.load_policy(answers(spark, sf_dir), policies(spark)))
    named = F.array_join(F.transform("post_sources", lambda s: s["source"]), ",")
    return done.select("doc_id", "decision", "post_answer", named.alias("post_sources"))


@query("r8_policy_simulation", DOCS + f""" SELECT doc_id, CASE WHEN tenant = 't0' THEN 'src1,src2' END AS f_sources, doc_type AS f_doc_type, CASE WHEN tenant = 't0' THEN 'eu' END AS f_region,
   CASE WHEN doc_id % 10 <> 3 THEN {_DECISION} END AS decision, CASE WHEN doc_id % 10 <> 3 THEN {_POST} END AS post_answer FROM docs""")
def r8(spark, sf_dir):
    """Sources given as plain strings; some rows without an answer."""
    rows = answers(spark, sf_dir).withColumn("sources", F.transform("sources", lambda s: s["source"])).withColumn(
        "answer", F.when(F.col("doc_id") % 10 != 3, F.col("answer"))
    )
    out = gv.policy_simulate(rows, policies(spark))
    return out.select("doc_id", F.array_join("f_sources", ",").alias("f_sources"), "f_doc_type", "f_region", "decision", "post_answer")


@query("f7_policy_filters", LOG + """ SELECT request_id, CASE WHEN tenant = 't0' THEN 'src1,src2' END AS f_sources, CASE tenant WHEN 't0' THEN coalesce(doc_type, 'de') WHEN 't2' THEN coalesce(doc_type, 'fr') ELSE doc_type END AS f_doc_type,
   CASE WHEN tenant = 't0' THEN CASE WHEN provider = 'beta' THEN 'us' ELSE 'eu' END END AS f_region FROM log""")
def f7(spark, sf_dir):
    log = vw.request_log(spark, sf_dir).withColumn("region", F.when(F.col("provider") == "beta", "us"))
    return fl.policy_hints(log, policies(spark)).select("request_id", F.array_join("f_sources", ",").alias("f_sources"), "f_doc_type", "f_region")


@query("x4_output_guardrails", DOCS + f""", g0 AS (SELECT *, tenant <> 't1' AS pii, tenant IN ('t0', 't2') AS sec, CASE tenant WHEN 't0' THEN 500 WHEN 't3' THEN 0 END AS mx FROM docs),
   g1 AS (SELECT *, CASE WHEN pii THEN {_pii('text')} ELSE text END AS a1, text AS a0 FROM g0),
   g2 AS (SELECT *, CASE WHEN sec THEN {_secrets('a1')} ELSE a1 END AS a2 FROM g1)
   SELECT doc_id, CASE WHEN mx > 0 AND length(a2) > mx THEN substr(a2, 1, mx) ELSE a2 END AS guarded,
     concat_ws(',', CASE WHEN a1 <> a0 THEN 'pii_redacted' END, CASE WHEN a2 <> a1 THEN 'secret_redacted' END, CASE WHEN mx > 0 AND length(a2) > mx THEN 'truncated' END) AS flags FROM g2""")
def x4(spark, sf_dir):
    cfg = local_table(spark, 
        [("t0", None, True, 500), ("t1", False, None, None), ("t2", True, True, None), ("t3", True, False, 0)],
        "tenant string, enable_pii_redaction boolean, enable_secret_redaction boolean, max_answer_chars int",
    )
    from siftwell.operators.routing import with_defaults

    rows = with_defaults(vw.texts(spark, sf_dir).withColumnRenamed("text", "answer"), cfg, gv.GUARDRAIL_DEFAULTS)
    out = gv.output_guardrails(rows)
    return out.select("doc_id", "guarded", F.array_join("guardrail_flags", ",").alias("flags"))


@query("x5_input_guardrails", """WITH c AS (SELECT conv_id, turn, lower(text) AS low, conv_id % 4 AS t FROM conversations),
   m AS (SELECT *, CASE t WHEN 0 THEN CASE WHEN contains(low, 'zzz') THEN 'zzz' WHEN contains(low, 'tion the') THEN 'tion the' WHEN contains(low, 'es') THEN 'es' END WHEN 1 THEN CASE WHEN contains(low, 'und') THEN 'und' END END AS matched FROM c)
   SELECT conv_id, turn, matched, matched IS NOT NULL AS blocked FROM m""")
def x5(spark, sf_dir):
    rows = vw.table(spark, sf_dir, "conversations").withColumn("tenant", vw.tenant_of("conv_id"))
    cfg = local_table(spark, [("t0", ["", "zzz", "Tion The", "es"]), ("t1", ["und"]), ("t2", [])], "tenant string, block_patterns array<string>")
    return gv.input_guardrail(rows, cfg, "text").select("conv_id", "turn", "matched", "blocked")


@query("r4_retention_sweep", DOCS + """, old AS (SELECT source FROM docs GROUP BY source HAVING max(date) <= DATE '2024-12-25'), deny AS (SELECT unnest(['src1', 'src2', 'srcX']) AS source)
   SELECT source, source NOT IN (SELECT source FROM deny) AS new FROM (SELECT source FROM old UNION SELECT source FROM deny)""")
def r4(spark, sf_dir):
    deny = local_table(spark, [("src1",), ("src2",), ("srcX",)], "source string")
    swept, fresh = gv.retention_sweep(vw.documents(spark, sf_dir), deny, 5, F.lit("2024-12-30"))
    return swept.join(fresh.withColumn("new", F.lit(True)), "source", "left").withColumn("new", F.coalesce("new", F.lit(False)))


@query("r5_soft_delete", DOCS + """ SELECT DISTINCT source FROM docs WHERE doc_type = 'fr' AND source <> 'src3' UNION SELECT 'srcX'""")
def r5(spark, sf_dir):
    docs = vw.documents(spark, sf_dir)
    deny = local_table(spark, [("srcX",), ("src3",)], "source string")
    deleted = gv.soft_delete(deny, docs.filter("doc_type = 'fr'"))
    return gv.soft_undelete(deleted, local_table(spark, [("src3",)], "source string"))


@query("a27_lifecycle_status", DOCS + " SELECT 'v2' AS active, 'v1' AS previous, 'primary' AS read_preferred, count(DISTINCT source) AS denied FROM docs WHERE doc_type = 'de'")
def a27(spark, sf_dir):
    import datetime as dt

    pointer = ing.scratch(spark, "pointer")
    tb.init_pointer(spark, pointer, "v1")
    tb.begin_canary(spark, pointer, "v2", dt.datetime(2024, 1, 1))
    tb.promote(spark, pointer, True, dt.datetime(2024, 1, 2))
    deny = vw.documents(spark, sf_dir).filter("doc_type = 'de'").select("source")
    return tb.lifecycle_status(spark, pointer, deny).select("active", "previous", "read_preferred", "denied")


@query("r6_promotion", "WITH " + vw.SQL_CHUNKS + """ SELECT count(*) AS rows, CAST(64 AS INTEGER) AS dim, 'gate_not_passed' AS reason FROM chunks
   UNION ALL SELECT count(*), 32, 'forced' FROM chunks WHERE length(text) > 0""")
def r6(spark, sf_dir):
    """A gate that failed keeps the active table, force replaces it; rows read through the pointer."""
    import datetime as dt

    from siftwell.operators import embed as em

    pointer, v1, v2 = ing.scratch(spark, "pointer"), ing.scratch(spark, "v1"), ing.scratch(spark, "v2")
    tb.write_index(em.embed(vw.chunks(spark, sf_dir).select("chunk_id", "tenant", "text")), v1)
    tb.init_pointer(spark, pointer, v1)
    tb.begin_canary(spark, pointer, v2, dt.datetime(2024, 1, 1))
    tb.write_index(em.reembed(spark.read.parquet(v1), em.HashedCounts(32))[0], v2)
    steps = []
    for gate, force in ((False, False), (False, True)):
        done = tb.promote(spark, pointer, gate, dt.datetime(2024, 1, 2), force)
        active = spark.read.parquet(done["pointer"]["active"])
        steps.append(
            active.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dim")).withColumn("reason", F.lit(done["reason"]))
        )
    return steps[0].unionByName(steps[1])


@query("r7_failover", DOCS + " SELECT tenant, count(*) AS count, 'primary' AS side FROM docs GROUP BY tenant UNION ALL SELECT tenant, count(*), 'secondary' FROM docs WHERE tenant <> 't3' GROUP BY tenant")
def r7(spark, sf_dir):
    """Reads before and after switching sides; the secondary misses one tenant."""
    docs = vw.documents(spark, sf_dir)
    pointer, one, two = ing.scratch(spark, "pointer"), ing.scratch(spark, "one"), ing.scratch(spark, "two")
    tb.write_index(docs, one)
    tb.write_index(docs.filter("tenant <> 't3'"), two)
    tb.init_pointer(spark, pointer, one)
    before = tb.read_preferred(spark, pointer, one, two).groupBy("tenant").count().withColumn("side", F.lit("primary"))
    tb.failover(spark, pointer, "secondary")
    return before.unionByName(tb.read_preferred(spark, pointer, one, two).groupBy("tenant").count().withColumn("side", F.lit("secondary")))


@query("s13_markdown_export", DOCS + """ SELECT doc_id, text || chr(10) || chr(10) || 'References:' || chr(10) || '1. ' || source || CASE WHEN doc_id % 3 <> 0 THEN ' (p.' || (doc_id % 9) || ')' ELSE '' END || chr(10) || '2. src0 (p.1)' AS content FROM docs""")
def s13(spark, sf_dir):
    return us.export_answer(answers(spark, sf_dir)).select("doc_id", "content")


@query("s13_json_export", DOCS + """ SELECT doc_id, json_extract_string(j, '$.answer') AS answer, json_extract_string(j, '$.citations[0].source') AS first_source, CAST(json_extract(j, '$.citations[0].page') AS BIGINT) AS first_page
   FROM (SELECT doc_id, CAST(json_object('answer', text, 'citations', json_array(json_object('source', source, 'page', CASE WHEN doc_id % 3 <> 0 THEN doc_id % 9 END), json_object('source', 'src0', 'page', 1))) AS JSON) AS j FROM docs)""")
def s13_json(spark, sf_dir):
    out = us.export_answer(answers(spark, sf_dir), "json")
    return out.select(
        "doc_id", F.get_json_object("content", "$.answer").alias("answer"), F.get_json_object("content", "$.citations[0].source").alias("first_source"),
        F.get_json_object("content", "$.citations[0].page").cast("long").alias("first_page"),
    )


@query("s14_audit_rows", DOCS + " SELECT 1704067200 + doc_id AS ts, tenant, length('question ' || doc_id) AS query_len, length(text) AS answer_len, source || ',src0' AS sources FROM docs")
def s14(spark, sf_dir):
    out = us.audit_rows(answers(spark, sf_dir))
    return out.withColumn("ts", sc.epoch(F.col("ts"))).withColumn("sources", F.array_join("sources", ","))


# ---- text and scalar functions -----------------------------------------------------------------------


@query("x6_expanded_queries", LOG + """, q AS (SELECT request_id, CASE provider WHEN 'alpha' THEN 'UAV aero ' WHEN 'beta' THEN 'Drone GNC ' ELSE '' END || query AS query FROM log)
   SELECT request_id, query || CASE WHEN contains(lower(query), 'uav') OR contains(lower(query), 'drone') THEN ' unmanned aerial vehicle' ELSE '' END || CASE WHEN contains(lower(query), 'gnc') THEN ' guidance navigation and control' ELSE '' END
     || CASE WHEN contains(lower(query), 'aero') THEN ' aerodynamics' ELSE '' END AS expanded FROM q""")
def x6(spark, sf_dir):
    word = F.when(F.col("provider") == "alpha", "UAV aero ").when(F.col("provider") == "beta", "Drone GNC ").otherwise("")
    return vw.request_log(spark, sf_dir).select("request_id", tx.expand_query(F.concat(word, F.col("query"))).alias("expanded"))


@query("x7_intents", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'error|exception|stack trace|failed|failure|bug|issue') THEN 'troubleshoot'
   WHEN len(list_filter(regexp_split_to_array(lower(text), '""" + WS + """'), lambda x: x <> '')) > 20 OR regexp_matches(lower(text), 'overview|explain|guide|walkthrough') THEN 'explore' ELSE 'lookup' END AS intent FROM conversations""")
def x7(spark, sf_dir):
    return vw.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.classify_intent(F.col("text")).alias("intent"))


@query("x8_arithmetic_queries", r"""SELECT o_orderkey, regexp_full_match(q, '[0-9\s+\-*/().]+') AS arithmetic FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '(' || o_custkey || ' + ' || o_orderkey || ') * 2.5 / 4' WHEN 1 THEN o_orderpriority ELSE '' END AS q FROM orders)""")
def x8(spark, sf_dir):
    m = F.col("o_orderkey") % 3
    expr = F.concat(F.lit("("), F.col("o_custkey").cast("string"), F.lit(" + "), F.col("o_orderkey").cast("string"), F.lit(") * 2.5 / 4"))
    q = F.when(m == 0, expr).when(m == 1, F.col("o_orderpriority")).otherwise("")
    return vw.table(spark, sf_dir, "orders").select("o_orderkey", tx.is_arithmetic(q).alias("arithmetic"))


@query("x9_prompts", uq._SESS + """, h AS (SELECT user_id, turn, tenant, q, list({'q': q, 'a': a}) OVER w AS prev FROM s WINDOW w AS (PARTITION BY tenant, user_id, session ORDER BY ts, turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
   b AS (SELECT *, CASE WHEN len(prev) > 0 THEN 'Previous context (most recent first):' || chr(10) || array_to_string(list_transform(list_reverse(prev), lambda e: 'Q: ' || e.q || chr(10) || 'A: ' || e.a), chr(10)) || chr(10) || chr(10) || 'New question: ' || q ELSE q END AS base FROM h)
   SELECT user_id, turn, CASE WHEN tenant IN ('t0', 't2') THEN 'Follow these tenant-specific instructions when answering:' || chr(10) || 'Be brief.' || chr(10) || chr(10) || 'Question: ' || base ELSE base END AS prompt FROM b""")
def x9(spark, sf_dir):
    from siftwell.operators import sessions as ss

    style = F.when(F.col("tenant").isin("t0", "t2"), " Be brief. ")
    return ss.episode_context(vw.turns(spark, sf_dir)).select("user_id", "turn", tx.assemble_prompt(F.col("q"), F.col("history"), style).alias("prompt"))


@query("x10_request_keys", LOG + """ SELECT request_id, sha256('{' || CASE WHEN doc_type IS NOT NULL THEN '"f":"' || doc_type || '",' ELSE '' END || '"ns":1,"q":"' || query || '","tenant":"' || tenant || '"}') AS reuse_key,
   substr(sha1(query || '|' || '{' || CASE WHEN doc_type IS NOT NULL THEN '"doc_type":"' || doc_type || '"' ELSE '' END || '}'), 1, 16) AS exact_key FROM log""")
def x10(spark, sf_dir):
    from siftwell.operators import reuse as ru

    keyed = ru.reuse_key(vw.request_log(spark, sf_dir))
    return keyed.select("request_id", "reuse_key", sc.exact_key(F.col("query"), F.to_json(F.struct("doc_type"))).alias("exact_key"))


@query("x11_parsed_maps", LOG + """ SELECT request_id, CASE tenant WHEN 't1' THEN CAST(600 AS BIGINT) WHEN 't2' THEN CAST(120 AS BIGINT) ELSE CAST(300 AS BIGINT) END AS ttl FROM log""")
def x11(spark, sf_dir):
    from siftwell.operators import reuse as ru

    return vw.request_log(spark, sf_dir).select("request_id", ru.tenant_ttl(" t1:600 , t2 : 120,").alias("ttl"))


@query("x12_decoded_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 4")
def x12(spark, sf_dir):
    """Event properties from JSON; broken rows (cut short here) are dropped."""
    e = vw.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 10 == 4, F.substring(F.col("props"), F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    schema = "k bigint, bad string"
    obj = F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return e.select("event_id", obj.alias("o")).filter(F.col("o").isNotNull() & F.col("o.bad").isNull()).select("event_id", F.col("o.k").alias("k"))


@query("x13_date_functions", LOG + """ SELECT request_id, epoch_us(ts) // 1000000 AS epoch, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(ts AS DATE) AS day, epoch_us(ts) // 60000000 AS minute,
   TRY_CAST(substr(CASE WHEN request_id % 4 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END, 1, 10) AS DATE) AS parsed FROM log""")
def x13(spark, sf_dir):
    from siftwell.operators import ordered as od

    text = F.when(F.col("request_id") % 4 == 0, "unknown").otherwise(sc.iso_z(F.col("ts")))
    return vw.request_log(spark, sf_dir).select(
        "request_id", sc.epoch(F.col("ts")).alias("epoch"), sc.iso_z(F.col("ts")).alias("iso"), F.to_date("ts").alias("day"),
        od.time_bucket("ts", 60).alias("minute"), sc.iso_day(text).alias("parsed"),
    )


@query("x14_array_functions", DOCS + f""", t AS (SELECT doc_id, list_distinct({rq._TOKENS % 'text'}) AS a FROM docs), p AS (SELECT x.doc_id, x.a, y.a AS b FROM t x JOIN t y ON y.doc_id = x.doc_id + 1)
   SELECT doc_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS together, list_has_any(a, b) AS overlap, list_contains(a, 'the') AS has_the,
     round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS jaccard FROM p""")
def x14(spark, sf_dir):
    """Token sets of neighbouring documents."""
    t = spread(vw.documents(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", F.array_distinct(tx.tokens(F.col("text"))).alias("a"))
    p = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return p.select(
        "doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_union("a", "b")).cast("long").alias("together"),
        F.arrays_overlap("a", "b").alias("overlap"), F.array_contains("a", "the").alias("has_the"), F.round(sc.sorted_overlap(F.col("a"), F.col("b")), 6).alias("jaccard"),
    )


@query("x16_answer_chunks", """WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '""" + rq.WS + """'), lambda x: x <> '') AS ws FROM documents)),
   c AS (SELECT doc_id, i, word, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS reach FROM w),
   p AS (SELECT doc_id, 0 AS ix, CAST(0 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS before FROM c WHERE i = 0
     UNION ALL SELECT p.doc_id, any_value(p.ix) + 1, min(c.i) + 1, min(c.reach) FROM p JOIN c ON c.doc_id = p.doc_id AND c.reach >= p.before + 128 GROUP BY p.doc_id),
   s AS (SELECT doc_id, ix, i, lead(i, 1, CAST(1000000000 AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY ix) AS e FROM p)
   SELECT s.doc_id, CAST(ix AS INTEGER) AS ix, string_agg(word, ' ' ORDER BY c.i) AS piece FROM s JOIN c ON c.doc_id = s.doc_id AND c.i >= s.i AND c.i < s.e GROUP BY ALL""")
def x16(spark, sf_dir):
    docs = spread(vw.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.posexplode(tx.answer_chunks(F.col("text"))).alias("ix", "piece"))
