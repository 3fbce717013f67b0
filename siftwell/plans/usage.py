"""Registered usage, limit, reuse, session, feedback, telemetry, routing and tuning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions import text as tx
from siftwell.operators import feedback as fb
from siftwell.operators import limits as lm
from siftwell.operators import ordered as od
from siftwell.operators import reuse as ru
from siftwell.operators import routing as rt
from siftwell.operators import sessions as ss
from siftwell.operators import telemetry as tm
from siftwell.operators import tuning as tn
from siftwell.operators import usage as us
from siftwell.plans import views as vw
from siftwell.plans.registry import query
from siftwell.session import local_table

LOG, FB, TURNS = "WITH " + vw.SQL_LOG, "WITH " + vw.SQL_FEEDBACK, "WITH " + vw.SQL_TURNS
AS_OF = "2024-01-15 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# ---- limits ------------------------------------------------------------------------------------------


@query("b1_rate_limit", LOG + """ SELECT request_id, n, n > 1 AS rejected FROM (
   SELECT request_id, row_number() OVER (PARTITION BY tenant, date_trunc('minute', ts) ORDER BY ts, request_id) AS n FROM log)""")
def b1(spark, sf_dir):
    return lm.rate_limit(vw.request_log(spark, sf_dir), 1, key="tenant").select("request_id", "n", "rejected")


@query("b1_tier_rate_limit", LOG + """ SELECT request_id, n, n > CASE tenant WHEN 't0' THEN 1 WHEN 't1' THEN 2 ELSE 300 END AS rejected FROM (
   SELECT request_id, tenant, row_number() OVER (PARTITION BY tenant, date_trunc('minute', ts) ORDER BY ts, request_id) AS n FROM log)""")
def b1_tier(spark, sf_dir):
    """Limit per tenant from its tier."""
    log = vw.request_log(spark, sf_dir)
    tiers = local_table(spark, [("t0", "free"), ("t1", "enterprise")], "tenant string, tier string")
    over = local_table(spark, [("free", 1), ("enterprise", 2)], "tier string, rate_per_min int")
    return lm.rate_limit(rt.with_limits(log, tiers, over), "rate_per_min", key="tenant").select("request_id", "n", "rejected")


@query("b4_daily_quota", LOG + """ SELECT request_id, n, n > 60 AS rejected FROM (
   SELECT request_id, row_number() OVER (PARTITION BY tenant, CAST(ts AS DATE) ORDER BY ts, request_id) AS n FROM log)""")
def b4(spark, sf_dir):
    return lm.daily_quota(vw.request_log(spark, sf_dir), 60).select("request_id", "n", "rejected")


@query("b2_budget_actions", LOG + """, t AS (SELECT *, greatest(1, (prompt_chars + answer_chars) // 4) AS tokens FROM log),
   r AS (SELECT request_id, tenant, CAST(sum(tokens) OVER (PARTITION BY tenant, CAST(ts AS DATE) ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens FROM t),
   s AS (SELECT *, running_tokens / 25000.0 AS spent, CASE tenant WHEN 't0' THEN 1.0 ELSE 1.4 END AS cap FROM r)
   SELECT request_id, running_tokens, CASE WHEN spent > cap * 1.2 THEN 'reject' WHEN spent > cap THEN 'downshift' ELSE 'allow' END AS action FROM s""")
def b2(spark, sf_dir):
    log = vw.request_log(spark, sf_dir).withColumn("cap", F.when(F.col("tenant") == "t0", 1.0).otherwise(1.4))
    return lm.budget_actions(log, "cap").select("request_id", "running_tokens", "action")


@query("b3_budget_throttle", LOG + """, t AS (SELECT *, greatest(1, prompt_chars // 4) * 5 + greatest(1, answer_chars // 4) * 15 AS micro FROM log),
   r AS (SELECT request_id, CAST(coalesce(sum(micro) OVER (PARTITION BY tenant, CAST(ts AS DATE) ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_micro FROM t)
   SELECT request_id, spent_micro, CASE WHEN spent_micro / 1e6 >= 0.4 THEN 'throttle' WHEN spent_micro / 1e6 >= CAST(0.4 AS DOUBLE) * CAST(0.8 AS DOUBLE) THEN 'cheap' ELSE 'allow' END AS decision FROM r""")
def b3(spark, sf_dir):
    return lm.budget_throttle(vw.request_log(spark, sf_dir), 0.4).select("request_id", "spent_micro", "decision")


_INTERVALS = """, iv AS (SELECT tenant, ts AS s, ts + to_microseconds(CAST(floor(latency_s * 1000000) AS BIGINT) * 60) AS e FROM log)"""


def intervals(spark, sf_dir):
    """Requests as intervals; a latency second stands for a minute so that they overlap."""
    log = vw.request_log(spark, sf_dir)
    end = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("latency_s") * 1000000).cast("long") * 60)
    return log.select("request_id", "tenant", F.col("ts").alias("start_ts"), end.alias("end_ts"))


@query("b5_concurrency_peak", LOG + _INTERVALS + """, ev AS (SELECT tenant, t, step, sum(step) AS change FROM (
     SELECT tenant, s AS t, 1 AS step FROM iv UNION ALL SELECT tenant, e, -1 FROM iv) GROUP BY ALL),
   span AS (SELECT tenant, CAST(floor(epoch_us(min(t)) / 300000000) AS BIGINT) AS a, CAST(floor(epoch_us(max(t)) / 300000000) AS BIGINT) AS b FROM ev GROUP BY tenant),
   al AS (SELECT tenant, t, step, change FROM ev UNION ALL SELECT tenant, make_timestamp(o * 300000000), 0, 0 FROM (SELECT tenant, unnest(range(a, b + 1)) AS o FROM span)),
   lv AS (SELECT tenant, t, sum(change) OVER (PARTITION BY tenant ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS level FROM al)
   SELECT tenant, CAST(floor(epoch_us(t) / 300000000) AS BIGINT) AS bucket, CAST(max(level) AS BIGINT) AS peak FROM lv GROUP BY ALL""")
def b5(spark, sf_dir):
    return lm.concurrency_peak(intervals(spark, sf_dir))


# ---- reuse -------------------------------------------------------------------------------------------


@query("j7_previous_within_tolerance", LOG + """ SELECT request_id, epoch_us(prev) // 1000000 AS prev_epoch FROM (SELECT request_id, ts,
   lag(ts) OVER (PARTITION BY tenant, query ORDER BY ts, request_id) AS prev FROM log) WHERE epoch_us(ts) - epoch_us(prev) < 7200 * CAST(1000000 AS BIGINT)""")
def j7(spark, sf_dir):
    """Backward as-of match with a tolerance of two hours."""
    out = ru.seen_within_ttl(vw.request_log(spark, sf_dir), F.lit(7200), ["tenant", "query"])
    return out.filter("hit").select("request_id", sc.epoch(F.col("prev_ts")).alias("prev_epoch"))


_HITS = LOG + """, h AS (SELECT request_id, tenant, coalesce(epoch_us(ts) - epoch_us(prev) < CASE tenant WHEN 't1' THEN 14400 WHEN 't2' THEN 60 ELSE 3600 END * CAST(1000000 AS BIGINT), false) AS hit
   FROM (SELECT *, lag(ts) OVER (PARTITION BY tenant, query, doc_type ORDER BY ts, request_id) AS prev FROM log))"""


def reuse_hits(spark, sf_dir):
    return ru.exact_reuse(vw.request_log(spark, sf_dir), ru.tenant_ttl("t1:14400, t2 : 60", 3600))


@query("b8_exact_reuse", _HITS + " SELECT request_id, hit FROM h")
def b8(spark, sf_dir):
    return reuse_hits(spark, sf_dir).select("request_id", "hit")


@query("b8_strict_replay")
def b8_replay(spark, sf_dir):
    """Hits that do not extend an entry's life; checked against a sequential replay in the tests."""
    return ru.replay_reuse(vw.request_log(spark, sf_dir), ["tenant", "query"], F.lit(14400)).select("request_id", "hit")


@query("a23_reuse_ratio", _HITS + " SELECT tenant, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / greatest(count(*), 1), 6) AS hit_ratio FROM h GROUP BY tenant")
def a23(spark, sf_dir):
    return ru.reuse_ratio(reuse_hits(spark, sf_dir)).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query("b9_negative_reuse", LOG + """ SELECT request_id, coalesce(epoch_us(ts) - epoch_us(last) < 7200 * CAST(1000000 AS BIGINT), false) AS suppressed FROM (
   SELECT *, max(CASE WHEN answer_chars < 200 THEN ts END) OVER (PARTITION BY tenant, query, doc_type ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM log)""")
def b9(spark, sf_dir):
    out = ru.negative_reuse(vw.request_log(spark, sf_dir), F.col("answer_chars") < 200, 7200)
    return out.select("request_id", "suppressed")


_BUMPS = ["2024-01-05 00:00:00", "2024-01-12 06:30:00", "2024-01-20 18:00:00"]
_BUMP_SQL = " + ".join(f"CASE WHEN ts >= TIMESTAMP '{b}' THEN 1 ELSE 0 END" for b in _BUMPS)


@query("b11_namespaced_reuse", LOG + f""", n AS (SELECT *, CAST(1 + {_BUMP_SQL} AS BIGINT) AS ns FROM log)
   SELECT request_id, ns, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY tenant, query, doc_type, ns ORDER BY ts, request_id)) < 14400 * CAST(1000000 AS BIGINT), false) AS hit FROM n""")
def b11(spark, sf_dir):
    bumps = local_table(spark, [(b,) for b in _BUMPS], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    spaced = ru.with_namespace(vw.request_log(spark, sf_dir), bumps)
    return ru.exact_reuse(spaced, F.lit(14400)).select("request_id", "ns", "hit")


def timed_vectors(spark, sf_dir):
    """Every vector as a query; a pause of an hour follows each run of 150."""
    v = vw.vectors(spark, sf_dir)
    secs = F.lit(1704067200) + F.col("vec_id") * 20 + F.floor(F.col("vec_id") / 150) * 3600
    return v.select("tenant", F.col("vec_id").alias("qid"), F.timestamp_seconds(secs).alias("ts"), "embedding")


_SEM = "WITH " + vw.SQL_VECTORS + """, q AS (SELECT tenant, vec_id AS qid, 1704067200 + vec_id * 20 + (vec_id // 150) * 3600 AS ts, embedding FROM vectors),
   p AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY ts, qid) AS pos, CASE WHEN ts - lag(ts) OVER (PARTITION BY tenant ORDER BY ts, qid) >= 600 THEN 1 ELSE 0 END AS fresh FROM q),
   e AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant ORDER BY ts, qid ROWS UNBOUNDED PRECEDING) AS ep FROM p),
   m AS (SELECT a.tenant, a.qid, b.qid AS match_id, b.pos AS bpos, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine
         FROM e a JOIN e b ON a.tenant = b.tenant AND a.ep = b.ep AND b.pos BETWEEN a.pos - 200 AND a.pos - 1)
   SELECT tenant, qid, match_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY tenant, qid ORDER BY cosine DESC, bpos) AS rn FROM m) WHERE rn = 1 AND cosine >= 0.3"""


@query("b10_semantic_reuse", _SEM)
def b10(spark, sf_dir):
    return ru.semantic_reuse(timed_vectors(spark, sf_dir), threshold=0.3)


@query("j8_similar_predecessor", _SEM.replace("- 200", "- 20").replace("0.3", "0.2"))
def j8(spark, sf_dir):
    """The twenty newest predecessors, in blocks of twenty-five."""
    return ru.semantic_reuse(timed_vectors(spark, sf_dir), threshold=0.2, newest=20, block=25)


# ---- sessions and trails -----------------------------------------------------------------------------

_SESS = TURNS + """, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= 3600 THEN 1 ELSE 0 END AS fresh FROM turns WINDOW w AS (PARTITION BY tenant, user_id ORDER BY ts, turn)),
   s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY tenant, user_id ORDER BY ts, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)"""


@query("b6_sessions", _SESS + " SELECT tenant, user_id, turn, session FROM s")
def b6_sessions(spark, sf_dir):
    return ss.sessions(vw.turns(spark, sf_dir)).select("tenant", "user_id", "turn", "session")


@query("b6_episode_context", _SESS + """ SELECT user_id, turn, coalesce(array_to_string(list_transform(list_reverse(list({'q': q, 'a': a}) OVER w), lambda e: 'Q: ' || e.q || chr(10) || 'A: ' || e.a), chr(10)), '') AS history
   FROM s WINDOW w AS (PARTITION BY tenant, user_id, session ORDER BY ts, turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def b6(spark, sf_dir):
    out = ss.episode_context(vw.turns(spark, sf_dir))
    return out.select("user_id", "turn", tx.history_block(F.col("history")).alias("history"))


_TRAIL = "CASE WHEN regexp_matches(lower(query), 'error|exception|stack trace|failed|failure|bug|issue') THEN 'troubleshoot' WHEN regexp_matches(lower(query), 'overview|explain|guide|walkthrough') THEN 'explore' ELSE 'lookup' END"


@query("b7_query_trail", LOG + f""" SELECT tenant, request_id, query, {_TRAIL} AS intent FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, request_id DESC) AS rn FROM log) WHERE rn <= 50""")
def b7(spark, sf_dir):
    return ss.query_trail(vw.request_log(spark, sf_dir)).select("tenant", "request_id", "query", "intent")


# ---- feedback ----------------------------------------------------------------------------------------


@query("a1_feedback_summary", FB + """, r AS (SELECT * FROM feedback),
   v AS (SELECT tenant, 'reason' AS kind, trim(reason) AS value FROM r UNION ALL SELECT tenant, 'tag', trim(t) FROM (SELECT tenant, unnest(tags) AS t FROM r)),
   c AS (SELECT tenant, kind, value, count(*) AS n FROM v WHERE value <> '' GROUP BY ALL),
   k AS (SELECT *, row_number() OVER (PARTITION BY tenant, kind ORDER BY n DESC, value) AS rk FROM c),
   l AS (SELECT tenant, string_agg(value || '=' || n, ',' ORDER BY rk) FILTER (kind = 'reason') AS top_reasons, string_agg(value || '=' || n, ',' ORDER BY rk) FILTER (kind = 'tag') AS top_tags FROM k WHERE rk <= 10 GROUP BY tenant)
   SELECT tenant, count(*) AS count, round(avg(CASE WHEN helpful THEN 1.0 ELSE 0.0 END), 6) AS helpful_rate, round(avg(CASE WHEN hallucinated THEN 1.0 ELSE 0.0 END), 6) AS hallucinated_rate,
     round(avg(style_score), 6) AS avg_style_score, coalesce(any_value(top_reasons), '') AS top_reasons, coalesce(any_value(top_tags), '') AS top_tags FROM r JOIN l USING (tenant) GROUP BY tenant
   UNION ALL SELECT 't9', 0, NULL, NULL, NULL, '', ''""")
def a1(spark, sf_dir):
    rows = vw.feedback(spark, sf_dir)
    tenants = rows.select("tenant").distinct().union(local_table(spark, [("t9",)], "tenant string"))
    out = fb.feedback_summary(rows, tenants)
    for c in ("helpful_rate", "hallucinated_rate", "avg_style_score"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("s7_feedback_export", FB + " SELECT tenant, helpful, reason, ts FROM (SELECT * FROM feedback ORDER BY ts DESC, doc_id DESC LIMIT 300) WHERE tenant = 't2'")
def s7(spark, sf_dir):
    """Newest 300 rows of all tenants, of which one tenant's are exported."""
    return fb.export_feedback(vw.feedback(spark, sf_dir), 300, "t2").withColumn("ts", sc.epoch(F.col("ts")))


@query("s15_feedback_rows", FB + " SELECT tenant, helpful, reason, hallucinated, style_score, coalesce(len(tags), 0) AS n_tags, CAST(0 AS BIGINT) AS n_clicked, ts FROM feedback")
def s15(spark, sf_dir):
    out = fb.append_feedback(vw.feedback(spark, sf_dir), as_of())
    return out.select(
        "tenant", "helpful", "reason", "hallucinated", "style_score", F.size("tags").cast("long").alias("n_tags"),
        F.size("clicked_sources").cast("long").alias("n_clicked"), sc.epoch(F.col("ts")).alias("ts"),
    )


@query("a17_rerank_canary", FB + """ SELECT tenant, count(*) AS count, round(avg(CASE WHEN helpful THEN 1.0 ELSE 0.0 END), 6) AS helpful_rate, avg(CASE WHEN helpful THEN 1.0 ELSE 0.0 END) >= 0.55 AS enable
   FROM feedback GROUP BY tenant""")
def a17(spark, sf_dir):
    return fb.rerank_canary(vw.feedback(spark, sf_dir)).withColumn("helpful_rate", F.round("helpful_rate", 6))


@query("a17_canary_history", FB + f""" SELECT tenant, avg(CASE WHEN helpful THEN 1.0 ELSE 0.0 END) >= 0.55 AS enable, round(avg(CASE WHEN helpful THEN 1.0 ELSE 0.0 END), 6) AS helpful_rate, count(*) AS count, epoch_us(TIMESTAMP '{AS_OF}') // 1000000 AS ts FROM feedback GROUP BY tenant""")
def a17_history(spark, sf_dir):
    out = fb.canary_history(fb.rerank_canary(vw.feedback(spark, sf_dir)), as_of())
    return out.withColumn("helpful_rate", F.round("helpful_rate", 6)).withColumn("ts", sc.epoch(F.col("ts")))


# ---- usage -------------------------------------------------------------------------------------------


@query("a9_query_hotspots", LOG + " SELECT CAST(ts AS DATE) AS day, tenant, doc_type, count(*) AS count FROM log GROUP BY ALL ORDER BY count DESC, day, tenant, doc_type NULLS FIRST LIMIT 50")
def a9(spark, sf_dir):
    return us.query_hotspots(vw.request_log(spark, sf_dir))


@query("a10_intent_mix", LOG + f""", t AS (SELECT tenant, {_TRAIL} AS intent FROM (SELECT tenant, 'case ' || event_word || ' ' || query AS query
     FROM (SELECT *, CASE provider WHEN 'alpha' THEN 'overview' WHEN 'delta' THEN 'failed' ELSE 'of' END AS event_word FROM log)))
   SELECT tenant, intent, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tenant), 6) AS share FROM t GROUP BY tenant, intent""")
def a10(spark, sf_dir):
    word = F.when(F.col("provider") == "alpha", "overview").when(F.col("provider") == "delta", "failed").otherwise("of")
    log = vw.request_log(spark, sf_dir).withColumn("query", F.concat(F.lit("case "), word, F.lit(" "), F.col("query")))
    return us.intent_mix(log).withColumn("share", F.round("share", 6))


@query("a11_temporal_range", LOG + """ SELECT tenant, CAST(grouping(tenant) AS INTEGER) AS is_total, epoch_us(min(ts)) // 1000000 AS start_ts, epoch_us(max(ts)) // 1000000 AS end_ts,
   strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS start_iso, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS end_iso FROM log GROUP BY GROUPING SETS ((), (tenant))""")
def a11(spark, sf_dir):
    return us.temporal_range(vw.request_log(spark, sf_dir))


@query("a12_source_freshness", LOG + f" SELECT provider AS source, greatest(0, epoch_us(TIMESTAMP '{AS_OF}') // 1000000 - epoch_us(max(ts)) // 1000000) AS lag_seconds FROM log GROUP BY provider UNION ALL SELECT 'omega', 0")
def a12(spark, sf_dir):
    rows = vw.request_log(spark, sf_dir).withColumnRenamed("provider", "source")
    known = rows.select("source").distinct().union(local_table(spark, [("omega",)], "source string"))
    return us.source_freshness(rows, as_of(), known)


_PAST = LOG + f", past AS (SELECT *, epoch_us(TIMESTAMP '{AS_OF}') // 1000000 - epoch_us(ts) // 1000000 AS age FROM log WHERE ts <= TIMESTAMP '{AS_OF}')"
LATENCY_WINDOW = 2 * 86400
_LAT = f""", lat AS (SELECT provider, latency_s, row_number() OVER (PARTITION BY provider ORDER BY latency_s, request_id) - 1 AS i, count(*) OVER (PARTITION BY provider) AS n
   FROM past WHERE status < 500 AND age <= {LATENCY_WINDOW}),
   pc AS (SELECT provider, max(latency_s) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(latency_s) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM lat GROUP BY provider),
   er AS (SELECT provider, count(*) FILTER (age <= 300) AS e, count(*) FILTER (age <= 86400) AS e_day FROM past WHERE status >= 500 GROUP BY provider),
   rq AS (SELECT provider, count(*) FILTER (age <= 60) AS r60, count(*) FILTER (age <= 86400) AS r_day FROM past GROUP BY provider)"""


@query("a13_provider_stats", _PAST + _LAT + """ SELECT provider, round(coalesce(p50, 0.0), 6) AS p50, round(coalesce(p95, 0.0), 6) AS p95, round(coalesce(e, 0) / 300.0, 6) AS error_rate_5m, round(r60 / 60.0, 6) AS qps_1m,
   CASE WHEN e IS NOT NULL THEN 'status 500' END AS last_error FROM rq LEFT JOIN pc USING (provider) LEFT JOIN er USING (provider)""")
def a13(spark, sf_dir):
    out = us.provider_stats(vw.request_log(spark, sf_dir), as_of(), LATENCY_WINDOW)
    for c in ("p50", "p95", "error_rate_5m", "qps_1m"):
        out = out.withColumn(c, F.round(c, 6))
    return out


def providers(spark):
    return local_table(spark, [("alpha",), ("beta",), ("gamma",), ("delta",), ("omega",)], "provider string")


_HEALTH = _PAST + _LAT + """, names AS (SELECT unnest(['alpha', 'beta', 'gamma', 'delta', 'omega']) AS provider),
   health AS (SELECT provider, coalesce(p95, 999.0) AS p95, CASE WHEN coalesce(r_day, 0) > 0 THEN coalesce(e_day, 0) / r_day ELSE 0.0 END AS err FROM names LEFT JOIN pc USING (provider) LEFT JOIN er USING (provider) LEFT JOIN rq USING (provider))"""


@query("a14_provider_health", _HEALTH + " SELECT provider, round(p95, 6) AS p95, round(err, 6) AS err FROM health")
def a14(spark, sf_dir):
    out = us.provider_health(vw.request_log(spark, sf_dir), as_of(), providers(spark), LATENCY_WINDOW, 86400)
    return out.withColumn("p95", F.round("p95", 6)).withColumn("err", F.round("err", 6))


@query("a18_review_resolutions", FB + " SELECT tenant, CASE WHEN trim(reason) = '' THEN 'ack' ELSE lower(trim(reason)) END AS resolution, count(*) AS n FROM feedback GROUP BY ALL")
def a18(spark, sf_dir):
    return us.hitl_resolutions(vw.feedback(spark, sf_dir).select("tenant", F.trim("reason").alias("resolution")))


@query("a19_ab_decisions", LOG + """ SELECT tenant, CASE tenant WHEN 't1' THEN 'B' ELSE 'A' END AS variant, tenant = 't2' AS rerank, count(*) AS n FROM log GROUP BY ALL""")
def a19(spark, sf_dir):
    assign = local_table(spark, [("t1", "B", None), ("t2", "C", "True"), ("t3", None, "false")], "tenant string, llm string, rerank string")
    return us.ab_decisions(vw.request_log(spark, sf_dir), assign)


@query("a20_replication_lag", LOG + """ SELECT greatest(0, max(epoch_us(ts) // 1000000) FILTER (provider <> 'beta') - max(epoch_us(ts) // 1000000) FILTER (provider = 'beta')) AS lag_seconds FROM log""")
def a20(spark, sf_dir):
    role = F.when(F.col("provider") == "beta", "secondary").otherwise("primary")
    return us.replication_lag(vw.request_log(spark, sf_dir).withColumn("role", role))


_TOK = ", tk AS (SELECT *, greatest(1, prompt_chars // 4) AS p, greatest(1, answer_chars // 4) AS c FROM log)"
_SUMS = "CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, round(CAST(sum(p * 5 + c * 15) AS BIGINT) / 1e6, 6) AS cost_usd"


@query("a21_usage_cost", LOG + _TOK + f" SELECT tenant, {_SUMS} FROM tk GROUP BY tenant")
def a21(spark, sf_dir):
    return us.usage_cost(vw.request_log(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("s9_cost_report", LOG + _TOK + f" SELECT CAST(ts AS DATE) AS day, tenant, {_SUMS} FROM tk GROUP BY ALL")
def s9(spark, sf_dir):
    return us.cost_report(vw.request_log(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("a22_usage_today", LOG + ' SELECT tenant, CAST(ts AS DATE) AS day, count(*) AS used, CAST(1000 AS INTEGER) AS "limit" FROM log GROUP BY ALL')
def a22(spark, sf_dir):
    return us.usage_today(vw.request_log(spark, sf_dir), lm.DAILY_QUOTA)


@query("a26_tenant_list", LOG + " SELECT DISTINCT tenant FROM (SELECT tenant FROM log UNION ALL SELECT 't' || (c_custkey % 6) FROM customer)")
def a26(spark, sf_dir):
    other = vw.table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 6).cast("string")).alias("tenant"))
    return us.tenant_list(vw.request_log(spark, sf_dir), other)


# ---- telemetry ---------------------------------------------------------------------------------------


def _win(seconds):
    return f"CAST(floor(epoch_us(ts) / {seconds}000000.0) AS BIGINT) * {seconds}"


@query("t1_request_rate", LOG + f" SELECT {_win(300)} AS window_start, tenant, round(count(*) / 300.0, 6) AS rate FROM log GROUP BY ALL")
def t1(spark, sf_dir):
    return tm.rate(vw.request_log(spark, sf_dir), ["tenant"]).withColumn("rate", F.round("rate", 6))


@query("t2_increase", LOG + f" SELECT {_win(86400)} AS window_start, tenant, CAST(sum(answer_chars) AS BIGINT) AS increase FROM log GROUP BY ALL")
def t2(spark, sf_dir):
    return tm.increase(vw.request_log(spark, sf_dir), F.col("answer_chars"), ["tenant"], 86400)


_EDGES = "[" + ", ".join(str(b) for b in tm.BOUNDS) + "]"


@query("t3_latency_quantiles", LOG + f""", e AS (SELECT {_EDGES} AS edges),
   b AS (SELECT {_win(3600)} AS window_start, provider, len(list_filter(edges, lambda x: x < latency_s)) AS b, count(*) AS c FROM log, e GROUP BY ALL),
   cum AS (SELECT *, sum(c) OVER (PARTITION BY window_start, provider ORDER BY b) AS cum, sum(c) OVER (PARTITION BY window_start, provider) AS n FROM b),
   q AS (SELECT *, qu * n AS r FROM cum, (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.95 AS DOUBLE)]) AS qu))
   SELECT window_start, provider, qu AS quantile, round(CASE WHEN b = len(edges) THEN edges[-1] ELSE CASE WHEN b = 0 THEN 0.0 ELSE edges[b] END
      + (edges[b + 1] - CASE WHEN b = 0 THEN 0.0 ELSE edges[b] END) * (r - (cum - c)) / c END, 6) AS value FROM q, e WHERE cum >= r AND cum - c < r""")
def t3(spark, sf_dir):
    out = tm.histogram_quantile(vw.request_log(spark, sf_dir), "latency_s", [0.5, 0.9, 0.95], ["provider"], 3600)
    return out.withColumn("value", F.round("value", 6))


@query("t3_exact_percentiles", LOG + """, o AS (SELECT provider, latency_s, row_number() OVER (PARTITION BY provider ORDER BY latency_s) - 1 AS i, count(*) OVER (PARTITION BY provider) AS n FROM log)
   SELECT provider, p, n, max(latency_s) FILTER (i = round_even(p * (n - 1), 0)) AS pctl FROM o, (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS p) GROUP BY provider, p, n""")
def t3_exact(spark, sf_dir):
    return od.rank_percentiles(vw.request_log(spark, sf_dir), ["provider"], "latency_s", [0.5, 0.9, 0.99])


@query("t3_merged_sketches", LOG + """, o AS (SELECT provider, span_start, latency_s, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY provider, span_start) AS n
     FROM (SELECT provider, latency_s, epoch_us(ts) // 86400000000 * 86400 AS span_start FROM log) WINDOW w AS (PARTITION BY provider, span_start ORDER BY latency_s))
   SELECT provider, span_start, p, n, max(latency_s) FILTER (i = round_even(p * (n - 1), 0)) AS pctl, true AS within FROM o, (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.95 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS p) GROUP BY provider, span_start, p, n""")
def t3_sketches(spark, sf_dir):
    """Five-minute sketches merged to days, held against the exact percentiles: within one hundredth everywhere."""
    log, probs = vw.request_log(spark, sf_dir), [0.5, 0.95, 0.99]
    merged = tm.sketch_quantiles(tm.value_sketches(log, "latency_s", ["provider"]), probs, ["provider"])
    day = (od.time_bucket("ts", 86400) * 86400).cast("long").alias("span_start")
    exact = od.rank_percentiles(log.select("provider", day, "latency_s"), ["provider", "span_start"], "latency_s", probs)
    near = F.abs(F.col("value") - F.col("pctl")) <= F.col("pctl") * 0.0100001
    return exact.join(merged, ["provider", "span_start", "p", "n"], "left").select("provider", "span_start", "p", "n", "pctl", F.coalesce(near, F.lit(False)).alias("within"))


@query("t4_error_share", LOG + f" SELECT {_win(3600)} AS window_start, round(count(*) FILTER (status >= 500) / count(*), 6) AS ratio, count(*) AS n FROM log GROUP BY ALL")
def t4(spark, sf_dir):
    return tm.ratio(vw.request_log(spark, sf_dir), F.col("status") >= 500, seconds=3600).withColumn("ratio", F.round("ratio", 6))


@query("t5_sliding_maximum", LOG + f""" SELECT (s - o) * 60 AS window_start, tenant, max(latency_s) AS max_value FROM (
   SELECT CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS s, tenant, latency_s, unnest(range(0, 5)) AS o FROM log) GROUP BY ALL""")
def t5(spark, sf_dir):
    return tm.max_over_time(vw.request_log(spark, sf_dir), "latency_s", ["tenant"], 300, 60)


@query("t6_totals", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def t6(spark, sf_dir):
    return tm.total(vw.table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long"), ["l_returnflag", "l_linestatus"])


@query("t7_alert_spans", LOG + f""", w AS (SELECT {_win(3600)} AS ws, count(*) FILTER (status >= 500) / count(*) AS ratio FROM log GROUP BY ALL),
   i AS (SELECT ws, ws - row_number() OVER (ORDER BY ws) * 3600 AS g FROM w WHERE ratio > 0.2)
   SELECT min(ws) AS span_start, max(ws) + 3600 AS span_end, count(*) AS windows, max(ws) + 3600 - min(ws) AS duration FROM i GROUP BY g HAVING max(ws) + 3600 - min(ws) >= 7200""")
def t7(spark, sf_dir):
    """Hours with more than a fifth of errors, for two hours or longer."""
    shares = tm.ratio(vw.request_log(spark, sf_dir), F.col("status") >= 500, seconds=3600)
    return tm.alert_spans(shares, F.col("ratio") > 0.2, 3600, 7200)


def _burn(bad: str, fast: float) -> str:
    return LOG + f""", f AS (SELECT {_win(300)} AS window_start, count(*) FILTER ({bad}) AS b, count(*) AS n FROM log GROUP BY ALL),
   l AS (SELECT *, sum(b) OVER hour AS sb, sum(n) OVER hour AS sn FROM f WINDOW hour AS (ORDER BY window_start RANGE BETWEEN 3300 PRECEDING AND CURRENT ROW)),
   x AS (SELECT *, b / n > {fast} AS fast_burn, sb / sn > 0.05 AS slow_burn FROM l),
   a AS (SELECT *, fast_burn AS fast_alert, count(*) FILTER (slow_burn) OVER hour = 12 AS slow_alert FROM x WINDOW hour AS (ORDER BY window_start RANGE BETWEEN 3300 PRECEDING AND CURRENT ROW))"""


@query("t8_burn_rate", _burn("status >= 500", 0.1) + " SELECT window_start, round(b / n, 6) AS fast_ratio, round(sb / sn, 6) AS slow_ratio, fast_burn, slow_burn, fast_burn AND slow_burn AS burning, fast_alert, slow_alert FROM a")
def t8(spark, sf_dir):
    out = tm.burn_rate(vw.request_log(spark, sf_dir), F.col("status") >= 500)
    return out.withColumn("fast_ratio", F.round("fast_ratio", 6)).withColumn("slow_ratio", F.round("slow_ratio", 6))


@query("t8_latency_burn", _burn("latency_s > 1.0", 0.05) + " SELECT window_start, fast_burn AND slow_burn AS burning, slow_alert FROM a")
def t8_latency(spark, sf_dir):
    """More than one request in twenty slower than a second, in both windows (p95 above a second)."""
    return tm.burn_rate(vw.request_log(spark, sf_dir), F.col("latency_s") > 1.0, fast_limit=0.05).select("window_start", "burning", "slow_alert")


@query("t9_objectives", LOG + """, m AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM log),
   o AS (SELECT month, latency_s, row_number() OVER (PARTITION BY month ORDER BY latency_s) - 1 AS i, count(*) OVER (PARTITION BY month) AS n FROM m),
   p AS (SELECT month, max(latency_s) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95_s, max(latency_s) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99_s FROM o GROUP BY month),
   a AS (SELECT month, count(*) AS requests, count(*) FILTER (status BETWEEN 200 AND 299 OR (status BETWEEN 400 AND 499 AND status <> 429)) / count(*) AS availability, count(*) FILTER (status >= 500) / count(*) AS error_rate FROM m GROUP BY month)
   SELECT month, requests, round(availability, 6) AS availability, round(error_rate, 6) AS error_rate, p95_s, p99_s,
     availability >= 0.999 AND error_rate <= 0.005 AND p95_s <= 1.5 AND p99_s <= 3.0 AS met FROM a JOIN p USING (month)""")
def t9(spark, sf_dir):
    out = tm.slo_attainment(vw.request_log(spark, sf_dir))
    return out.withColumn("availability", F.round("availability", 6)).withColumn("error_rate", F.round("error_rate", 6))


@query("j9_request_durations", LOG + _INTERVALS.replace("SELECT tenant, ts AS s", "SELECT request_id, ts AS s") + " SELECT request_id, (epoch_us(e) - epoch_us(s)) // 1000 AS duration_ms FROM iv")
def j9(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    rows = iv.select("request_id", F.lit("request_start").alias("event"), F.col("start_ts").alias("ts")).unionByName(
        iv.select("request_id", F.lit("request_end").alias("event"), F.col("end_ts").alias("ts"))
    )
    return tm.request_durations(rows).select("request_id", "duration_ms")


# ---- configuration and routing -----------------------------------------------------------------------


@query("j3_settings_over_defaults", LOG + """ SELECT tenant, CASE tenant WHEN 't1' THEN 'quality' WHEN 't2' THEN 'latency' ELSE 'balanced' END AS objective,
   CASE tenant WHEN 't1' THEN 'beta,alpha' ELSE 'alpha' END AS allowed, count(*) AS n FROM log GROUP BY ALL""")
def j3(spark, sf_dir):
    cfg = local_table(spark, [("t1", "quality", ["beta", "alpha"]), ("t2", "latency", None)], "tenant string, objective string, allowed_providers array<string>")
    counted = vw.request_log(spark, sf_dir).groupBy("tenant").agg(F.count("*").alias("n"))
    return rt.router_policy(counted, cfg, ["alpha"]).select("tenant", "objective", F.array_join("allowed_providers", ",").alias("allowed"), "n")


_TIERS = """, tl AS (SELECT tenant, CASE tenant WHEN 't0' THEN 'free' WHEN 't1' THEN 'enterprise' WHEN 't2' THEN 'gold' ELSE 'pro' END AS tier FROM (SELECT DISTINCT tenant FROM log)),
   lim AS (SELECT tenant, tier, CASE tier WHEN 'free' THEN 90 WHEN 'enterprise' THEN 1200 ELSE 300 END AS rate_per_min, CASE tier WHEN 'free' THEN 2 WHEN 'enterprise' THEN 32 ELSE 8 END AS concurrent_max, 4 AS k_min,
     CASE tier WHEN 'free' THEN 10 WHEN 'enterprise' THEN 32 ELSE 20 END AS k_max, 10 AS fetch_min, CASE tier WHEN 'free' THEN 20 WHEN 'enterprise' THEN 80 ELSE 50 END AS fetch_max,
     CAST(CASE tier WHEN 'free' THEN 5.0 WHEN 'enterprise' THEN 500.0 ELSE 50.0 END AS DOUBLE) AS daily_usd_cap FROM tl)"""


def limits(spark, sf_dir):
    log = vw.request_log(spark, sf_dir)
    tiers = local_table(spark, [("t0", "Free"), ("t1", "enterprise"), ("t2", "gold")], "tenant string, tier string")
    return rt.tier_limits(log.select("tenant").distinct(), tiers, local_table(spark, [("free", 90)], "tier string, rate_per_min int"))


@query("r3_tier_limits", LOG + _TIERS + " SELECT * FROM lim")
def r3(spark, sf_dir):
    return limits(spark, sf_dir)


@query("s8_tenant_summaries", LOG + _TIERS + """ SELECT tenant, '{"tenant":"' || tenant || '","tier":"' || tier || '","limits":{"rate_per_min":' || rate_per_min || ',"concurrent_max":' || concurrent_max || ',"k_min":4,"k_max":' || k_max
   || ',"fetch_min":10,"fetch_max":' || fetch_max || ',"daily_usd_cap":' || daily_usd_cap || '}}' AS summary FROM lim""")
def s8(spark, sf_dir):
    return rt.tenant_summaries(limits(spark, sf_dir))


_POLICY_ROWS = [
    ("t0", "latency", ["alpha", "beta", "gamma"], 2000.0, None, None, None),
    ("t1", "cost", ["gamma", "beta"], None, None, 0.0001, None),
    ("t2", "quality", ["delta", "alpha"], None, 0.2, None, {"type2": "alpha"}),
    ("t3", "balanced", ["omega", "beta", "alpha"], 5000.0, 0.5, None, {"type1": "alpha", "type9": "beta"}),
]
_POLICY_SCHEMA = (
    "tenant string, objective string, allowed_providers array<string>, max_p95_ms double, max_error_rate_5m double, max_prompt_cost_per_1k double, doc_type_overrides map<string,string>"
)
_COST_ROWS = [("alpha", "base", 0.01), ("beta", "base", 0.002), ("gamma", "base", 0.003), ("delta", "other", 0.001)]


@query("r1_provider_routing", _HEALTH + """, pol(tenant, objective, allowed, p95cap, errcap, costcap) AS (VALUES ('t0', 'latency', ['alpha', 'beta', 'gamma'], 2000.0, NULL, NULL), ('t1', 'cost', ['gamma', 'beta'], NULL, NULL, 0.0001),
     ('t2', 'quality', ['delta', 'alpha'], NULL, 0.2, NULL), ('t3', 'balanced', ['omega', 'beta', 'alpha'], 5000.0, 0.5, NULL)),
   cost(provider, prompt) AS (VALUES ('alpha', CAST(0.01 AS DOUBLE)), ('beta', 0.002), ('gamma', 0.003)),
   pairs AS (SELECT DISTINCT tenant, doc_type FROM log),
   cand AS (SELECT tenant, doc_type, objective, p95cap, errcap, costcap, unnest(allowed) AS provider, unnest(range(len(allowed))) AS pos FROM pairs JOIN pol USING (tenant)),
   ov AS (SELECT *, CASE WHEN tenant = 't2' AND doc_type = 'type2' AND provider = 'alpha' THEN -1 WHEN tenant = 't3' AND doc_type = 'type1' AND provider = 'alpha' THEN -1 ELSE pos END AS p2 FROM cand),
   sc AS (SELECT *, coalesce(prompt, 999.0) AS c FROM ov LEFT JOIN health USING (provider) LEFT JOIN cost USING (provider)),
   ok AS (SELECT *, (p95cap IS NULL OR p95 * 1000 <= p95cap) AND (errcap IS NULL OR err <= errcap) AND (costcap IS NULL OR c <= costcap) AS good,
     CASE objective WHEN 'latency' THEN p95 WHEN 'cost' THEN c WHEN 'quality' THEN err ELSE p95 + c END AS metric FROM sc),
   best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant, doc_type ORDER BY good DESC, metric, p2) AS rn FROM ok) WHERE rn = 1)
   SELECT l.request_id, b.provider AS routed_provider, CASE objective WHEN 'latency' THEN 'small' WHEN 'cost' THEN 'small' WHEN 'quality' THEN 'large' ELSE 'base' END AS routed_model,
     objective || CASE WHEN good THEN '' WHEN objective = 'quality' THEN '_slo_failover' ELSE '_slo_violation' END AS reason
   FROM log l JOIN best b ON l.tenant = b.tenant AND l.doc_type IS NOT DISTINCT FROM b.doc_type""")
def r1(spark, sf_dir):
    log = vw.request_log(spark, sf_dir)
    health = us.provider_health(log, as_of(), providers(spark), LATENCY_WINDOW, 86400)
    policy = local_table(spark, _POLICY_ROWS, _POLICY_SCHEMA)
    costs = local_table(spark, _COST_ROWS, "provider string, model string, prompt double")
    return rt.route_provider(log, policy, health, costs, "base", "small", "large").select("request_id", "routed_provider", "routed_model", "reason")


@query("r2_policy_and_costs", LOG + """ SELECT provider, 'base' AS model, CASE provider WHEN 'alpha' THEN CAST(0.01 AS DOUBLE) WHEN 'beta' THEN 0.002 WHEN 'gamma' THEN 0.003 END AS prompt, count(*) AS n FROM log GROUP BY ALL""")
def r2(spark, sf_dir):
    pairs = vw.request_log(spark, sf_dir).groupBy("provider").agg(F.count("*").alias("n")).withColumn("model", F.lit("base"))
    return rt.model_costs(pairs, local_table(spark, _COST_ROWS, "provider string, model string, prompt double"))


@query("f8_collection_routes", LOG + """ SELECT request_id, CASE WHEN tenant = 't1' AND doc_type = 'type2' THEN 't1_type2' WHEN tenant = 't1' THEN 't1_all' WHEN tenant = 't3' AND doc_type = 'type4' THEN 't3_type4' ELSE 'default' END AS collection FROM log""")
def f8(spark, sf_dir):
    from siftwell.operators import filters as fl

    routes = local_table(spark, [("t1:type2", "t1_type2"), ("t1", "t1_all"), ("t3:type4", "t3_type4")], "route_key string, collection string")
    return fl.route_collection(vw.request_log(spark, sf_dir), routes).select("request_id", "collection")


_SIG = FB.replace("feedback AS", "feedback AS", 1) + ", " + vw.SQL_LOG + f""",
   fr AS (SELECT tenant, avg(CASE WHEN helpful THEN 1.0 ELSE 0.0 END) AS hr, avg(CASE WHEN hallucinated THEN 1.0 ELSE 0.0 END) AS ha FROM feedback GROUP BY tenant),
   tr AS (SELECT tenant, {_TRAIL} AS intent FROM (SELECT tenant, CASE WHEN provider = 'delta' AND tenant IN ('t0', 't1') THEN 'failed' WHEN provider = 'alpha' THEN 'guide' ELSE 'of' END || ' ' || query AS query FROM log)),
   mx AS (SELECT tenant, count(*) FILTER (intent = 'troubleshoot') / count(*) AS ts, count(*) FILTER (intent = 'lookup') / count(*) AS ls FROM tr GROUP BY tenant),
   vo AS (SELECT tenant, dt, count(*) AS c FROM (SELECT tenant, CASE WHEN tenant = 't2' AND doc_type IS NOT NULL THEN 'manual' ELSE doc_type END AS dt FROM log) GROUP BY ALL),
   tp AS (SELECT * FROM (SELECT tenant, dt, c / tot AS sh, row_number() OVER (PARTITION BY tenant ORDER BY c DESC, dt) AS rn FROM (SELECT *, sum(c) OVER (PARTITION BY tenant) AS tot FROM vo) WHERE dt IS NOT NULL) WHERE rn = 1),
   sug AS (SELECT tenant, 'router_policy' AS kind, CASE WHEN hr < 0.6 THEN 'low_helpful_rate' ELSE 'high_helpful_low_hallucinations' END AS reason, CASE WHEN hr < 0.6 THEN 'quality' ELSE 'cost' END AS target, hr AS metric FROM fr WHERE hr < 0.6 OR (hr > 0.85 AND ha < 0.05)
     UNION ALL SELECT tenant, 'retrieval_depth', CASE WHEN ts > 0.3 THEN 'high_troubleshoot_intent_share' ELSE 'dominant_lookup_intent' END, NULL, CASE WHEN ts > 0.3 THEN ts ELSE ls END FROM mx WHERE ts > 0.3 OR ls > 0.6
     UNION ALL SELECT tenant, 'index_routing', 'dominant_doc_type_volume', dt, sh FROM tp WHERE sh >= 0.5)"""


def suggestions(spark, sf_dir):
    rows = vw.feedback(spark, sf_dir)
    log = vw.request_log(spark, sf_dir)
    word = F.when((F.col("provider") == "delta") & F.col("tenant").isin("t0", "t1"), "failed").when(F.col("provider") == "alpha", "guide").otherwise("of")
    mix = us.intent_mix(log.withColumn("query", F.concat(word, F.lit(" "), F.col("query"))))
    kinds = log.withColumn("doc_type", F.when((F.col("tenant") == "t2") & F.col("doc_type").isNotNull(), "manual").otherwise(F.col("doc_type")))
    volume = us.query_hotspots(kinds, limit=None)
    return tn.tuning_suggestions(log.select("tenant"), fb.feedback_rates(rows), mix, volume)


@query("a24_tuning_suggestions", _SIG + " SELECT tenant, kind, reason, target, round(metric, 6) AS metric FROM sug")
def a24(spark, sf_dir):
    return suggestions(spark, sf_dir).select("tenant", "kind", "reason", "target", F.round("metric", 6).alias("metric"))


@query("a25_tuning_plan", _SIG + """, pl AS (SELECT *, CASE tenant WHEN 't0' THEN 'Quality' WHEN 't1' THEN 'balanced' END AS old, CASE WHEN kind = 'index_routing' THEN lower(tenant || ':' || target) END AS route_key FROM sug),
   sk AS (SELECT *, CASE WHEN kind = 'router_policy' AND lower(coalesce(old, '')) = target THEN 'already_set' WHEN kind = 'index_routing' AND route_key = 't3:manual' THEN 'route_already_set' WHEN kind = 'retrieval_depth' THEN 'not_applicable' END AS skip_reason FROM pl)
   SELECT tenant, kind, target, route_key, skip_reason IS NULL AS applied, skip_reason, CASE WHEN skip_reason IS NULL THEN CASE kind WHEN 'router_policy' THEN target ELSE tenant || '_' || target END END AS new_value,
     CASE WHEN skip_reason IS NULL AND kind = 'router_policy' THEN old END AS old_value FROM sk""")
def a25(spark, sf_dir):
    policy = local_table(spark, [("t0", "Quality"), ("t1", "balanced")], "tenant string, objective string")
    routes = local_table(spark, [("t3:manual", "x")], "route_key string, collection string")
    return tn.tuning_plan(suggestions(spark, sf_dir), policy, routes)
