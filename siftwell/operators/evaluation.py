"""Retrieval quality, control/treatment comparison and index gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions import text as tx
from siftwell.operators import ordered as od
from siftwell.session import side_by_side

# Drift and gate thresholds.
DRIFT_WINDOW, DRIFT_ROWS, DRIFT_EDGE = 3600, 10, 0.05
GATE = {"max_latency_increase_pct": 20.0, "min_source_overlap": 0.8}
DEFAULT_TENANT = "__default__"


def part_share(parts: Column, answer: Column, when_empty: float) -> Column:
    """Share of ``parts`` contained in the answer, ignoring case; empty parts never count as contained."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    found = F.filter(parts, lambda p: (p != "") & low.contains(F.lower(p)))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, F.lit(when_empty)).otherwise(F.size(found) / F.size(parts).cast("double"))


def eval_rows(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Per golden row whether an expected source was retrieved and which share of the expected parts was answered.

    ``golden``: query_id, tenant, expected_sources, expected_answer_contains, expected_doc_type. ``results``:
    query_id, sources, answer, error. Rows without a result, or with an error, score nothing and have ``ran`` false.
    """
    joined = golden.join(results.select("query_id", "sources", "answer", "error", F.lit(True).alias("__got")), "query_id", "left")
    ran = F.coalesce(F.col("__got"), F.lit(False)) & F.col("error").isNull()
    empty = F.array().cast("array<string>")
    hit = F.coalesce(F.arrays_overlap(F.coalesce("expected_sources", empty), F.coalesce("sources", empty)), F.lit(False))
    first = F.coalesce(F.try_element_at("expected_sources", F.lit(1)), F.lit(""))
    return joined.select(
        "query_id",
        F.coalesce(F.nullif(tx.strip(F.col("tenant")), F.lit("")), F.lit(DEFAULT_TENANT)).alias("tenant"),
        F.coalesce(F.nullif(tx.strip(F.col("expected_doc_type")), F.lit("")), sc.doc_type_of(first)).alias("doc_type"),
        ran.alias("ran"),
        F.when(ran & hit, 1).otherwise(0).alias("hit"),
        F.when(ran, part_share(F.col("expected_answer_contains"), F.col("answer"), 0.0)).otherwise(0.0).alias("answer_score"),
    )


def offline_eval(rows: DataFrame) -> DataFrame:
    """Recall and mean answer score over all golden rows, failed ones included."""
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.agg(
        F.count("*").alias("total"), (F.sum("hit") / n).alias("recall_at_k"), (F.sum("answer_score") / n).alias("avg_answer_contains")
    )


def offline_eval_slices(rows: DataFrame) -> DataFrame:
    """The same measures per tenant and per doc type, over the rows that ran."""
    return rows.filter("ran").groupingSets([["tenant"], ["doc_type"]], "tenant", "doc_type").agg(
        F.count("*").alias("n"), F.avg("hit").alias("recall_at_k"), F.avg("answer_score").alias("avg_answer_contains"),
        F.grouping("tenant").alias("__g"),
    ).select(
        F.when(F.col("__g") == 0, "tenant").otherwise("doc_type").alias("slice_type"),
        F.when(F.col("__g") == 0, F.col("tenant")).otherwise(F.col("doc_type")).alias("slice_key"),
        "n", "recall_at_k", "avg_answer_contains",
    )


def harness_eval(golden: DataFrame, results: DataFrame, k: int = 3) -> DataFrame:
    """Recall within the first ``k`` sources and keyword hit rate, averaged over all golden rows."""
    joined = golden.join(results.select("query_id", "sources", "answer"), "query_id", "left")
    empty = F.array().cast("array<string>")
    hit = F.coalesce(F.arrays_overlap(F.coalesce("expected_sources", empty), F.slice(F.coalesce("sources", empty), 1, k)), F.lit(False))
    got = F.col("answer").isNotNull()
    return joined.select(
        F.when(got & hit, 1.0).otherwise(0.0).alias("r"), F.when(got, part_share(F.col("keywords"), F.col("answer"), 1.0)).otherwise(0.0).alias("w")
    ).agg(F.count("*").alias("n"), F.avg("r").alias("avg_recall"), F.avg("w").alias("avg_keyword_hit"))


def eval_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest ``limit`` evaluation runs with the change of both measures since the run before."""
    from pyspark.sql import Window

    # The change is taken among the kept runs (at most ``limit`` rows), so the global window stays tiny.
    kept = od.keep_latest(runs, limit, [F.col("ts").desc(), F.col("run_id").desc()])
    w = Window.partitionBy(F.lit(0)).orderBy("ts", "run_id")
    return kept.withColumn("recall_delta", F.col("recall_at_k") - F.lag("recall_at_k").over(w)).withColumn(
        "answer_delta", F.col("avg_answer_contains") - F.lag("avg_answer_contains").over(w)
    )


def drift_status(judged: DataFrame, as_of: Column, window: int = DRIFT_WINDOW, tenant: str | None = None) -> DataFrame:
    """Wins, ties and mean score change inside the window that ends at ``as_of`` (all rows with window 0), with a verdict once there are ten rows.

    One row, or one per tenant when ``tenant`` is ``"*"``.
    """
    age = sc.epoch(as_of) - sc.epoch(F.col("ts"))
    rows = judged.filter((age >= 0) & (age <= window) if window else F.lit(True))
    if tenant not in (None, "*"):
        rows = rows.filter(F.col("tenant") == tenant)
    grouped = rows.groupBy("tenant") if tenant == "*" else rows.groupBy()
    delta = F.col("treatment_score") - F.col("control_score")
    out = grouped.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("winner") == "control").alias("control_wins"),
        F.count_if(F.col("winner") == "treatment").alias("treatment_wins"),
        F.count_if(~F.coalesce(F.col("winner").isin("control", "treatment"), F.lit(False))).alias("ties"),
        F.round(F.coalesce(F.avg(delta), F.lit(0.0)), 6).alias("avg_delta"),
    )
    enough = F.col("total") >= DRIFT_ROWS
    return out.withColumn(
        "status",
        F.when(enough & (F.col("avg_delta") < -DRIFT_EDGE), "regressed").when(enough & (F.col("avg_delta") > DRIFT_EDGE), "improved").otherwise("stable"),
    )


def normalise_judge(raw: DataFrame, reply: str = "reply") -> DataFrame:
    """Scores and winner from a judge's free-text reply: the JSON between its first and last brace."""
    body = F.regexp_extract(F.col(reply), r"(?s)(\{.*\})", 1)
    obj = F.from_json(body, "control_score string, treatment_score string, winner string", {"mode": "PERMISSIVE"})
    out = raw.withColumn("__o", obj)
    for side in ("control", "treatment"):
        out = out.withColumn(f"{side}_score", F.coalesce(F.col(f"__o.{side}_score").try_cast("double"), F.lit(0.0)))
    winner = F.lower(F.coalesce(F.col("__o.winner"), F.lit("tie")))
    gap = F.col("treatment_score") - F.col("control_score")
    return out.withColumn(
        "winner",
        F.when(winner.isin("control", "treatment", "tie"), winner)
        .when(F.abs(gap) < DRIFT_EDGE, "tie").when(gap > 0, "treatment").otherwise("control"),
    ).drop("__o")


def shadow_pairs(runs: DataFrame) -> DataFrame:
    """One row per query with the control run and the treatment run side by side.

    ``runs``: query_id, tenant, bucket, model, rerank, result, sources, error.
    """
    side = F.struct("model", "rerank", "result", "sources", "error")
    return runs.groupBy("query_id", "tenant").agg(
        F.first(F.when(F.col("bucket") == "control", side), ignorenulls=True).alias("control"),
        F.first(F.when(F.col("bucket") == "treatment", side), ignorenulls=True).alias("treatment"),
    )


def measure_index(runs: DataFrame, keys: tuple[str, ...] = ("collection",)) -> DataFrame:
    """p50 and p95 latency per collection over the queries that did not fail."""
    ok = runs.filter(F.col("error").isNull())
    pct = od.rank_percentiles(ok, list(keys), "latency_s", [0.5, 0.95])
    return pct.groupBy(*keys).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("pctl"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("pctl"))).alias("p95"),
        F.max("n").alias("n"),
    )


def query_sources(runs: DataFrame) -> DataFrame:
    """Distinct non-empty sources of each run (none when it failed)."""
    named = F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s != "")
    ok = F.when(F.col("error").isNull(), F.sort_array(F.array_distinct(named))).otherwise(F.array().cast("array<string>"))
    return runs.withColumn("source_set", ok)


def canary_gate(active: DataFrame, canary: DataFrame, cfg: dict[str, float] | None = None) -> DataFrame:
    """Whether the new index may replace the active one: p95 increase and mean source overlap per query."""
    g = {**GATE, **(cfg or {})}
    pairs = query_sources(active).select("query_id", F.col("source_set").alias("a")).join(
        query_sources(canary).select("query_id", F.col("source_set").alias("b")), "query_id"
    )
    overlap = pairs.agg(F.coalesce(F.avg(sc.sorted_overlap(F.col("a"), F.col("b"))), F.lit(0.0)).alias("avg_source_overlap"))
    both = active.select(F.lit("active").alias("collection"), "latency_s", "error").unionByName(
        canary.select(F.lit("canary").alias("collection"), "latency_s", "error")
    )
    p95 = measure_index(both).agg(
        F.max(F.when(F.col("collection") == "active", F.col("p95"))).alias("p95_active"),
        F.max(F.when(F.col("collection") == "canary", F.col("p95"))).alias("p95_canary"),
    )
    row = side_by_side(p95, overlap)
    pct = (F.col("p95_canary") - F.col("p95_active")) / F.greatest(F.lit(1e-6), F.col("p95_active")) * 100.0
    return row.withColumn("latency_increase_pct", pct).withColumn(
        "pass",
        F.coalesce(
            (F.col("latency_increase_pct") <= g["max_latency_increase_pct"]) & (F.col("avg_source_overlap") >= g["min_source_overlap"]),
            F.lit(False),
        ),
    )
