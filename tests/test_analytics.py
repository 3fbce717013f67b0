"""Limits, reuse, sessions, feedback, evaluation, governance and routing on small fixtures and against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import evaluation as ev
from siftwell.operators import feedback as fb
from siftwell.operators import filters as fl
from siftwell.operators import governance as gv
from siftwell.operators import limits as lm
from siftwell.operators import reuse as ru
from siftwell.operators import review as rv
from siftwell.operators import routing as rt
from siftwell.operators import sessions as ss
from siftwell.operators import telemetry as tm
from siftwell.operators import usage as us


def requests(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"request_id long, tenant string, query string, doc_type string, sec double{extra}").withColumn(
        "ts", F.timestamp_micros((F.col("sec") * 1000000).cast("long"))
    )


def test_third_request_of_a_minute_is_rejected(spark):
    log = requests(spark, [(1, "a", "q", None, 0.0), (2, "a", "q", None, 10.0), (3, "a", "q", None, 59.0), (4, "a", "q", None, 60.0), (5, "b", "q", None, 30.0)])
    got = {r["request_id"]: r["rejected"] for r in lm.rate_limit(log, 2, key="tenant").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}


def test_budget_actions_and_throttle(spark):
    rows = [(i, "a", "q", None, float(i), 40_000, 0) for i in range(1, 8)]
    log = requests(spark, rows, ", prompt_chars long, answer_chars long")
    # 10000 tokens are 0.4 dollars each.
    actions = [r["action"] for r in lm.budget_actions(log, 1.0).orderBy("request_id").collect()]
    assert actions == ["allow", "allow", "downshift", "reject", "reject", "reject", "reject"]
    # 10000 prompt tokens and one completion token are 0.050015 dollars each.
    states = [r["decision"] for r in lm.budget_throttle(log, 0.2, 0.8).orderBy("request_id").collect()]
    assert states == ["allow", "allow", "allow", "allow", "throttle", "throttle", "throttle"]


def test_concurrency_peak_equals_sweep(spark):
    r = random.Random(3)
    rows = [(i, f"t{i % 2}", s, s + r.randrange(1, 900)) for i in range(200) for s in [r.randrange(0, 3000)]]
    df = spark.createDataFrame(rows, "id long, tenant string, s long, e long").select(
        "tenant", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts")
    )
    got = {(g["tenant"], g["bucket"]): g["peak"] for g in lm.concurrency_peak(df).collect()}
    for t in ("t0", "t1"):
        events = sorted([(s, 1) for _, x, s, _ in rows if x == t] + [(e, -1) for _, x, _, e in rows if x == t])
        events = sorted(events + [(b * 300, 0) for b in range(events[0][0] // 300, events[-1][0] // 300 + 1)])
        level, peaks = 0, {}
        for at, step in events:
            level += step
            peaks[at // 300] = max(peaks.get(at // 300, -1), level)
        assert {k[1]: v for k, v in got.items() if k[0] == t} == peaks


def strict(rows, ttl):
    last: dict = {}
    out = {}
    for rid, tenant, query, _, sec in sorted(rows, key=lambda x: (int(x[4]), x[0])):
        key = (tenant, query)
        if key in last and int(sec) - last[key] < ttl:
            out[rid] = True
        else:
            out[rid], last[key] = False, int(sec)
    return out


def test_strict_replay_equals_sequential(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["a", "b"]), r.choice(["hot", "hot", "hot", "x", None]), None, r.randrange(0, 4000) / 2) for i in range(500)]
    got = {x["request_id"]: x["hit"] for x in ru.replay_reuse(requests(spark, rows), ["tenant", "query"], F.lit(60)).collect()}
    assert got == strict(rows, 60)


def test_reuse_expires_and_stays_in_its_tenant(spark):
    rows = [(1, "a", "q", None, 0.0), (2, "a", "q", None, 0.9), (3, "b", "q", None, 0.95), (4, "a", "q", None, 2.0), (5, "a", "q", "pdf", 2.1)]
    got = {x["request_id"]: x["hit"] for x in ru.exact_reuse(requests(spark, rows), F.lit(1)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}
    per_tenant = ru.exact_reuse(requests(spark, rows), ru.tenant_ttl("a:10", 1))
    assert {x["request_id"] for x in per_tenant.filter("hit").collect()} == {2, 4}


def test_invalidation_ends_earlier_entries(spark):
    log = requests(spark, [(1, "a", "q", None, 10.0), (2, "a", "q", None, 20.0), (3, "a", "q", None, 30.0), (4, "a", "q", None, 9000.0)])
    bumps = spark.createDataFrame([(25,), (25,), (8000,)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    spaced = ru.with_namespace(log, bumps)
    assert {r["request_id"]: r["ns"] for r in spaced.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["request_id"] for r in ru.exact_reuse(spaced, F.lit(300)).filter("hit").collect()} == {2}


def test_suppression_after_an_empty_answer(spark):
    log = requests(spark, [(1, "a", "q", None, 0.0, 0), (2, "a", "q", None, 14.0, 5), (3, "a", "q", None, 16.0, 5)], ", answer_chars int")
    got = {r["request_id"]: r["suppressed"] for r in ru.negative_reuse(log, F.col("answer_chars") == 0).collect()}
    assert got == {1: False, 2: True, 3: False}


def nearest_before(rows, newest, threshold, ttl):
    out: dict = {}
    for tenant in {r[0] for r in rows}:
        seq = sorted([r for r in rows if r[0] == tenant], key=lambda r: (r[2], r[1]))
        epoch, epochs = 0, []
        for i, r in enumerate(seq):
            epoch += i == 0 or r[2] - seq[i - 1][2] >= 2 * ttl
            epochs.append(epoch)
        for i, r in enumerate(seq):
            best = None
            for j in range(max(0, i - newest), i):
                if epochs[j] != epochs[i]:
                    continue
                a, b = np.array(r[3]), np.array(seq[j][3])
                c = round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)
                if c > 0 and c >= threshold and (best is None or c > best[1]):
                    best = (seq[j][1], c)
            if best:
                out[r[1]] = best[0]
    return out


@pytest.mark.parametrize("block", [10, 2000])
def test_semantic_reuse_equals_scan(spark, block):
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 5))
    rows = [("hot" if i % 4 else "b", i, int(i * 10 + 700 * (i // 40)), [float(x) for x in base[i % 6] + r.normal(size=5) * 0.2]) for i in range(160)]
    df = spark.createDataFrame(rows, "tenant string, qid long, s long, embedding array<double>").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["qid"]: x["match_id"] for x in ru.semantic_reuse(df, 0.92, 8, 300, block=block).collect()}
    assert got == nearest_before(rows, 8, 0.92, 300) and got


def test_similar_vector_hits_other_misses(spark):
    rows = [("t", 1, 0, [1.0, 0.0, 0.0]), ("t", 2, 10, [0.999, 0.001, 0.0]), ("t", 3, 20, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "tenant string, qid long, s long, embedding array<double>").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r["qid"], r["match_id"]) for r in ru.semantic_reuse(df, 0.9).collect()] == [(2, 1)]
    lonely = df.filter("qid in (1, 3)")
    assert ru.semantic_reuse(lonely, 0.9).count() == 0


@pytest.mark.parametrize("block", [5, 1000])
def test_history_holds_recent_turns_of_the_session(spark, block):
    r = random.Random(4)
    rows, sec = [], 0
    for i in range(120):
        sec += r.choice([10, 500, 3599, 3600, 9000])
        rows.append(("t", 1, i, sec))
    df = spark.createDataFrame(rows, "tenant string, user_id long, turn long, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn(
        "q", F.concat(F.lit("q"), "turn")
    ).withColumn("a", F.concat(F.lit("a"), "turn"))
    got = {x["turn"]: [h["q"] for h in x["history"]] for x in ss.episode_context(df, block=block).collect()}
    for i in range(120):
        expected = []
        for j in range(i - 1, max(-1, i - 6), -1):
            if rows[j + 1][3] - rows[j][3] >= 3600:
                break
            expected.append(f"q{j}")
        assert got[i] == expected


def test_feedback_summary_three_valued(spark):
    rows = [(i, "a", i % 2 == 0, "slow" if i < 3 else "", True if i == 1 else None, 4 if i == 0 else None, ["x", " ", "x "] if i < 2 else None, i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, tenant string, helpful boolean, reason string, hallucinated boolean, style_score int, tags array<string>, s long").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    tenants = spark.createDataFrame([("a",), ("none",)], "tenant string")
    got = {r["tenant"]: r for r in fb.feedback_summary(df, tenants).collect()}
    a = got["a"]
    assert (a["count"], a["helpful_rate"], a["hallucinated_rate"], a["avg_style_score"], a["top_reasons"], a["top_tags"]) == (4, 0.5, 0.25, 4.0, "slow=3", "x=4")
    assert got["none"]["count"] == 0 and got["none"]["helpful_rate"] is None
    assert fb.append_feedback(df.drop("tags"), F.current_timestamp()).first()["tags"] == []
    assert fb.rerank_canary(df).first()["enable"] is False
    assert fb.export_feedback(df, 2).count() == 2 and fb.newest_per_tenant(df, 2, "doc_id", "global", "other").count() == 0


def test_offline_eval_divides_by_all_rows(spark):
    golden = spark.createDataFrame(
        [(1, "a", ["x.pdf"], ["stall", "margin"], None), (2, "", ["y.html"], [], None), (3, "a", ["z"], None, "memo"), (4, "b", None, ["q"], None)],
        "query_id long, tenant string, expected_sources array<string>, expected_answer_contains array<string>, expected_doc_type string",
    )
    results = spark.createDataFrame(
        [(1, ["x.pdf", "k"], "The STALL speed", None), (2, ["n"], "t", None), (3, ["z"], "t", "timeout")],
        "query_id long, sources array<string>, answer string, error string",
    )
    rows = ev.eval_rows(golden, results)
    total = ev.offline_eval(rows).first()
    assert (total["total"], total["recall_at_k"], total["avg_answer_contains"]) == (4, 0.25, 0.125)
    slices = {(r["slice_type"], r["slice_key"]): (r["n"], r["recall_at_k"]) for r in ev.offline_eval_slices(rows).collect()}
    assert slices == {("tenant", "a"): (1, 1.0), ("tenant", "__default__"): (1, 0.0), ("doc_type", "pdf"): (1, 1.0), ("doc_type", "html"): (1, 0.0)}
    kw = golden.withColumn("keywords", F.when(F.col("query_id") == 1, F.array(F.lit("Stall"), F.lit("zzz"))))
    h = ev.harness_eval(kw, results, 1).first()
    assert (h["n"], h["avg_recall"], h["avg_keyword_hit"]) == (4, 0.5, (0.5 + 1 + 1 + 0) / 4)


def test_recall_grows_with_k(spark):
    golden = spark.createDataFrame([(i, [f"s{i}"], ["w"]) for i in range(6)], "query_id long, expected_sources array<string>, keywords array<string>")
    results = spark.createDataFrame([(i, [f"s{j}" for j in range(6)], "w") for i in range(6)], "query_id long, sources array<string>, answer string")
    values = [ev.harness_eval(golden, results, k).first()["avg_recall"] for k in range(1, 7)]
    assert values == sorted(values) and values[-1] == 1.0


def test_judge_replies(spark):
    rows = ['x {"control_score": 0.2, "treatment_score": "0.9", "winner": "Treatment"} y', '{"control_score": 0.5, "treatment_score": 0.52, "winner": "?"}', "none", '{"treatment_score": 0.4, "winner": "?"}']
    got = ev.normalise_judge(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, reply string")).orderBy("id").collect()
    assert [(r["control_score"], r["treatment_score"], r["winner"]) for r in got] == [(0.2, 0.9, "treatment"), (0.5, 0.52, "tie"), (0.0, 0.0, "tie"), (0.0, 0.4, "treatment")]


def test_concurrency_carries_its_level_into_quiet_buckets(spark):
    rows = [("t", 0, 310), ("t", 0, 310), ("t", 10, 910)]
    df = spark.createDataFrame(rows, "tenant string, s long, e long").select("tenant", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"))
    assert {r["bucket"]: r["peak"] for r in lm.concurrency_peak(df).collect()} == {0: 3, 1: 3, 2: 1, 3: 1}


def busy_log(spark, seconds=120, per_second=200):
    """200 requests a second up to second 120, every fourth of them failed."""
    return spark.range(seconds * per_second).select(
        F.col("id").alias("request_id"), F.timestamp_seconds(F.col("id") / per_second).alias("ts"), F.lit("p").alias("provider"),
        F.when(F.col("id") % 4 == 0, 500).otherwise(200).alias("status"), (F.col("id") % 1000 / 1000).alias("latency_s"),
    )


def test_provider_numbers_do_not_saturate(spark):
    as_of = F.timestamp_seconds(F.lit(120))
    row = us.provider_stats(busy_log(spark), as_of, 300).first()
    assert row["qps_1m"] == pytest.approx(200, abs=4) and row["error_rate_5m"] == pytest.approx(24000 / 4 / 300)
    assert (row["p50"], row["p95"]) == (pytest.approx(0.5, abs=0.005), pytest.approx(0.95, abs=0.005)) and row["last_error"] == "status 500"
    names = spark.createDataFrame([("p",), ("q",)], "provider string")
    health = {r["provider"]: r for r in us.provider_health(busy_log(spark), as_of, names, 300).collect()}
    assert health["p"]["err"] == pytest.approx(0.25) and (health["q"]["p95"], health["q"]["err"]) == (999.0, 0.0)


def test_burn_looks_back_not_ahead(spark):
    rows = [(s, s < 300 and i == 0) for s in range(0, 300, 10) for i in (0, 1)] + [(3000 + s, False) for s in range(0, 300)]
    df = spark.createDataFrame(rows, "s long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["window_start"]: r for r in tm.burn_rate(df, F.col("bad")).collect()}
    assert (got[0]["fast_ratio"], got[0]["slow_ratio"], got[0]["burning"], got[0]["slow_alert"]) == (0.5, 0.5, True, False)
    assert got[3000]["fast_ratio"] == 0 and got[3000]["slow_ratio"] == pytest.approx(30 / 360)
    steady = spark.range(0, 7200, 10).select(F.timestamp_seconds("id").alias("ts"), F.lit(True).alias("bad"))
    got = {r["window_start"]: r["slow_alert"] for r in tm.burn_rate(steady, F.col("bad")).collect()}
    assert [got[w] for w in (3000, 3300, 6900)] == [False, True, True]


def test_drift_ignores_the_future(spark):
    rows = [(i, "a", 0.1, 0.9, "treatment", 100 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "request_id long, tenant string, control_score double, treatment_score double, winner string, s long").withColumn("ts", F.timestamp_seconds("s"))
    row = ev.drift_status(df, F.timestamp_seconds(F.lit(50))).first()
    assert (row["total"], row["status"]) == (0, "stable")


def test_queries_of_white_space_are_refused(spark):
    rows = [(0, "\n"), (1, " \u00a0 "), (2, None), (3, "\t what \n"), (4, "x" * 4001), (5, "y" * 4000)]
    valid, invalid = fl.valid_queries(spark.createDataFrame(rows, "id long, query string"))
    assert {r["id"]: r["query"][:4] for r in valid.collect()} == {3: "what", 5: "yyyy"}
    assert {r["id"]: r["reason"] for r in invalid.collect()} == {0: "empty_query", 1: "empty_query", 2: "empty_query", 4: "query_too_long"}


def test_percentiles_of_many_distinct_values(spark):
    from siftwell.operators import ordered as od

    df = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.lit(3.0) + F.col("id") / 1e12).alias("x")).union(spark.createDataFrame([("k", -1e9), ("k", 1e9)], "k string, x double"))
    got = {r["p"]: r["pctl"] for r in od.rank_percentiles(df, ["k"], "x", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got[0.0] == -1e9 and got[1.0] == 1e9
    assert got[0.5] == 3.0 + 499_999 / 1e12 and got[0.95] == 3.0 + round(0.95 * 1_000_001 - 1) / 1e12


def test_drift_needs_ten_rows(spark):
    rows = [(i, "a", 0.5, 0.3, "control", i) for i in range(10)]
    df = spark.createDataFrame(rows, "request_id long, tenant string, control_score double, treatment_score double, winner string, s long").withColumn("ts", F.timestamp_seconds("s"))
    as_of = F.timestamp_seconds(F.lit(9))
    assert ev.drift_status(df, as_of).first()["status"] == "regressed"
    assert ev.drift_status(df.filter("request_id > 0"), as_of).first()["status"] == "stable"
    assert ev.drift_status(df, as_of, 4, "a").first()["total"] == 5


def test_canary_gate_thresholds(spark):
    def runs(latency, sources):
        return spark.createDataFrame([(i, s, latency, None) for i, s in enumerate(sources)], "query_id long, sources array<string>, latency_s double, error string")

    active = runs(1.0, [["a", "b"], ["c"], []])
    assert ev.canary_gate(active, runs(1.2, [["a", "b"], ["c"], []])).first()["avg_source_overlap"] == pytest.approx(2 / 3)
    assert ev.canary_gate(runs(1.0, [["a"]]), runs(1.15, [["a"]])).first()["pass"] is True
    assert ev.canary_gate(runs(1.0, [["a"]]), runs(1.3, [["a"]])).first()["pass"] is False
    assert ev.canary_gate(runs(1.0, [["a"]]), runs(1.0, [["b"]])).first()["pass"] is False


def test_policy_tiers(spark):
    rows = [(t, "mail a@b.io", [("s", 1)], o) for t in ("deny", "mask", "redact", "allow", "glass", "unset") for o in (False, True)]
    df = spark.createDataFrame(rows, "tenant string, answer string, sources array<struct<source:string,page:int>>, override boolean")
    pol = spark.createDataFrame([(t, t, False) for t in ("deny", "mask", "redact", "allow")] + [("glass", "deny", True)], "tenant string, pii_tier string, break_glass boolean")
    got = {(r["tenant"], r["override"]): (r["decision"], r["post_answer"], [s["source"] for s in r["post_sources"]]) for r in gv.policy_post(gv.load_policy(df, pol)).collect()}
    assert got[("deny", True)] == ("denied", "", [])
    assert got[("mask", False)] == ("masked", "mail [MASKED_EMAIL]", ["[MASKED_SOURCE]"])
    assert got[("redact", False)] == got[("unset", True)] == ("redacted", "mail [REDACTED_EMAIL]", ["s"])
    assert got[("allow", False)] == ("allowed", "mail a@b.io", ["s"])
    assert got[("glass", True)] == ("overridden", "mail a@b.io", ["s"]) and got[("glass", False)][0] == "denied"


def test_guardrail_flags_in_order(spark):
    df = spark.createDataFrame(
        [("a@b.io token=ABCDEFGH and more", True, True, 20), ("clean", True, True, 100), (None, False, False, None)],
        "answer string, enable_pii_redaction boolean, enable_secret_redaction boolean, max_answer_chars int",
    )
    got = [(r["guarded"], r["guardrail_flags"]) for r in gv.output_guardrails(df).collect()]
    assert got[0][1][0] == "pii_redacted" and got[0][1][-1] == "truncated" and len(got[0][0]) == 20
    assert got[1] == ("clean", []) and got[2] == ("", [])


def test_sweep_is_idempotent_and_can_be_off(spark):
    index = spark.createDataFrame([("old", "2024-01-01"), ("old", "2023-01-01"), ("new", "2024-03-01")], "source string, date string").withColumn("date", F.col("date").cast("date"))
    deny = spark.createDataFrame([("x",)], "source string")
    swept, fresh = gv.retention_sweep(index, deny, 30, F.lit("2024-03-05"))
    assert {r[0] for r in swept.collect()} == {"x", "old"} and [r[0] for r in fresh.collect()] == ["old"]
    again, none = gv.retention_sweep(index, swept, 30, F.lit("2024-03-05"))
    assert {r[0] for r in again.collect()} == {"x", "old"} and none.count() == 0
    assert gv.retention_sweep(index, deny, 0, F.lit("2024-03-05"))[1].count() == 0
    assert {r[0] for r in gv.soft_undelete(swept, spark.createDataFrame([("old",)], "source string")).collect()} == {"x"}
    assert fl.denylist_size(swept).first()["denied"] == 2


def test_router_prefers_providers_within_objectives(spark):
    health = spark.createDataFrame([("a", 2.0, 0.0), ("b", 0.5, 0.3), ("c", 1.0, 0.0)], "provider string, p95 double, err double")
    costs = spark.createDataFrame([("a", "m", 0.1), ("b", "m", 0.5)], "provider string, model string, prompt double")
    schema = "tenant string, objective string, allowed_providers array<string>, max_p95_ms double, max_error_rate_5m double, max_prompt_cost_per_1k double, doc_type_overrides map<string,string>"
    policy = spark.createDataFrame(
        [("lat", "latency", ["a", "b", "c"], None, 0.1, None, None), ("cost", "cost", ["b", "a"], 100.0, None, None, None), ("qual", "quality", ["a", "c"], None, None, None, {"pdf": "c"}),
         ("bal", None, ["a", "b"], None, None, None, None)], schema,
    )
    log = spark.createDataFrame([("lat", None), ("cost", None), ("qual", "PDF"), ("qual", None), ("bal", "x"), ("stranger", None)], "tenant string, doc_type string")
    got = {(r["tenant"], r["doc_type"]): (r["routed_provider"], r["routed_model"], r["reason"]) for r in rt.route_provider(log, policy, health, costs, "m", "cheap", "best", "other").collect()}
    assert got[("lat", None)] == ("c", "cheap", "latency")
    assert got[("cost", None)] == ("a", "cheap", "cost_slo_violation")
    assert got[("qual", "PDF")][0] == "c" and got[("qual", None)] == ("a", "best", "quality")
    assert got[("bal", "x")] == ("b", "m", "balanced")
    assert got[("stranger", None)] == ("other", "m", "balanced")


def test_review_queue_reasons_and_cap(spark):
    df = spark.createDataFrame([(i, 0.1 if i % 2 else 0.9, i) for i in range(50)], "qid long, confidence double, s long").withColumn("ts", F.timestamp_seconds("s"))
    queue = rv.review_page(rv.hitl_queue(df, rate=0.0), 10)
    assert {r["qid"] for r in queue.collect()} == set(range(31, 50, 2))
    reasons = {r["review_reason"] for r in rv.hitl_queue(df, rate=1.0).collect()}
    assert reasons == {"low_conf", "sample"}
    a, b = fl.sample_stable(df, 0.3, "qid"), fl.sample_stable(df, 0.3, "qid")
    assert sorted(r["qid"] for r in a.collect()) == sorted(r["qid"] for r in b.collect())


def test_alerts_histograms_and_freshness(spark):
    w = spark.createDataFrame([(0, 0.5), (60, 0.6), (120, 0.1), (180, 0.9), (300, 0.9)], "window_start long, ratio double")
    spans = tm.alert_spans(w, F.col("ratio") > 0.2, 60, 120).collect()
    assert [(s["span_start"], s["span_end"], s["windows"]) for s in spans] == [(0, 120, 2)]
    lat = spark.createDataFrame([(float(x) / 100,) for x in range(1, 101)] + [(50.0,)] * 3, "v double")
    got = {r["quantile"]: r["value"] for r in tm.histogram_quantile(lat, "v", [0.5, 0.99], seconds=None).collect()}
    assert got[0.5] == pytest.approx(0.5 + 0.25 * (51.5 - 50) / 25) and got[0.99] == 10.0
    seen = spark.createDataFrame([("a", 100), ("a", 50), ("b", 500)], "source string, s long").withColumn("ts", F.timestamp_seconds("s"))
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    lags = {r["source"]: r["lag_seconds"] for r in us.source_freshness(seen, F.timestamp_seconds(F.lit(160)), known).collect()}
    assert lags == {"a": 60, "b": 0, "c": 0}


def test_merged_sketches_stay_within_their_error(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(0, 7200), rng.choice(["a", "b"]), rng.choice([0.0, rng.lognormvariate(0, 3), None])) for _ in range(800)]
    df = spark.createDataFrame(rows, "s long, k string, x double").withColumn("ts", F.timestamp_seconds("s"))
    sketches = tm.value_sketches(df, "x", ["k"], 300, 0.02)
    assert sketches.agg(F.countDistinct("window_start")).first()[0] > 20
    got = {(r["span_start"], r["k"], r["p"]): (r["n"], r["value"]) for r in tm.sketch_quantiles(sketches, [0.0, 0.5, 0.9, 1.0], ["k"], 3600, 0.02).collect()}
    for (start, k, p), (n, value) in got.items():
        own = sorted(x for s, kk, x in rows if kk == k and s // 3600 * 3600 == start and x is not None)
        exact = own[round(p * (len(own) - 1))]
        assert n == len(own) and abs(value - exact) <= 0.0200001 * exact
    assert len(got) == 16
