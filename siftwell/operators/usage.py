"""Usage, volume, freshness and provider statistics over a request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions import text as tx
from siftwell.operators import ordered as od
from siftwell.operators.limits import log_tokens

# Window sizes of the provider report in seconds and the stand-in for missing statistics.
ERROR_WINDOW, RATE_WINDOW = 300, 60
MISSING = 999.0


def query_hotspots(log: DataFrame, day: str | None = None, limit: int | None = 50) -> DataFrame:
    """Queries per (day, tenant, doc type), largest first; a missing doc type is NULL."""
    days = log.withColumn("day", F.to_date("ts"))
    if day is not None:
        start = F.lit(day).cast("timestamp")
        days = days.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    counted = days.groupBy("day", "tenant", "doc_type").agg(F.count("*").alias("count"))
    if not limit or limit <= 0:
        return counted
    return counted.orderBy(F.col("count").desc(), "day", "tenant", F.col("doc_type").asc_nulls_first()).limit(limit)


def intent_mix(log: DataFrame, newest: int | None = None, order: str = "request_id") -> DataFrame:
    """Share of each intent among a tenant's queries, or among its ``newest`` ones."""
    rows = log.select("tenant", "ts", order, "query")
    rows = rows if newest is None else od.keep_latest(rows, newest, [F.col("ts").desc(), F.col(order).desc()], ["tenant"])
    counted = rows.withColumn("intent", tx.classify_intent(F.col("query"))).groupBy("tenant", "intent").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("tenant")))


def temporal_range(df: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last time over everything (tenant NULL) and per tenant, also as ISO text."""
    grouped = df.groupingSets([[], ["tenant"]], "tenant").agg(
        F.min(ts).alias("__a"), F.max(ts).alias("__b"), F.grouping("tenant").alias("is_total")
    )
    return grouped.select(
        "tenant", F.col("is_total").cast("int").alias("is_total"), sc.epoch(F.col("__a")).alias("start_ts"), sc.epoch(F.col("__b")).alias("end_ts"),
        sc.iso_z(F.col("__a")).alias("start_iso"), sc.iso_z(F.col("__b")).alias("end_iso"),
    )


def source_freshness(df: DataFrame, as_of: Column, known: DataFrame | None = None, source: str = "source", ts: str = "ts") -> DataFrame:
    """Seconds since each source was last seen, never negative; 0 for a source without a time."""
    last = df.groupBy(source).agg(F.max(ts).alias("last_ts"))
    if known is not None:
        last = known.select(source).distinct().join(last, source, "left")
    lag = F.greatest(F.lit(0).cast("long"), sc.epoch(as_of) - sc.epoch(F.col("last_ts")))
    return last.select(source, F.coalesce(lag, F.lit(0).cast("long")).alias("lag_seconds"))


def _age(as_of: Column) -> Column:
    return sc.epoch(as_of) - sc.epoch(F.col("ts"))


def _latencies(past: DataFrame, failed: Column, as_of: Column, window: int, probs: Sequence[tuple[str, float]]) -> DataFrame:
    good = past.filter(~failed & F.col("latency_s").isNotNull() & (_age(as_of) <= window)).select("provider", "latency_s")
    ranked = od.rank_percentiles(good, ["provider"], "latency_s", [p for _, p in probs])
    return ranked.groupBy("provider").agg(*[F.max(F.when(F.col("p") == p, F.col("pctl"))).alias(name) for name, p in probs])


def provider_stats(log: DataFrame, as_of: Column, latency_window: int, order: str = "request_id", error: Column | None = None) -> DataFrame:
    """Per provider: p50 and p95 of the good requests' latencies over ``latency_window`` seconds, errors per second over
    300 s, requests per second over 60 s, and the latest error. All rows inside a window count."""
    past = log.filter(F.col("ts") <= as_of)
    failed = error if error is not None else F.col("status") >= 500
    lat = _latencies(past, failed, as_of, latency_window, [("p50", 0.5), ("p95", 0.95)])
    counts = past.groupBy("provider").agg(
        (F.count_if(failed & (_age(as_of) <= ERROR_WINDOW)) / float(ERROR_WINDOW)).alias("error_rate_5m"),
        (F.count_if(_age(as_of) <= RATE_WINDOW) / float(RATE_WINDOW)).alias("qps_1m"),
        F.max_by(F.when(failed, F.concat(F.lit("status "), F.col("status").cast("string"))), F.when(failed, F.struct("ts", order))).alias("last_error"),
    )
    return counts.join(lat, "provider", "left").select(
        "provider", F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"), "error_rate_5m", "qps_1m", "last_error",
    )


def provider_health(log: DataFrame, as_of: Column, providers: DataFrame, latency_window: int, window: int = ERROR_WINDOW) -> DataFrame:
    """Per provider: p95 latency over ``latency_window`` seconds (999 without any) and the share of errors among the requests
    of the last ``window`` seconds (0 without any)."""
    past = log.filter(F.col("ts") <= as_of)
    failed = F.col("status") >= 500
    lat = _latencies(past, failed, as_of, latency_window, [("p95", 0.95)])
    share = past.filter(_age(as_of) <= window).groupBy("provider").agg((F.count_if(failed) / F.count("*")).alias("err"))
    return providers.select("provider").distinct().join(lat, "provider", "left").join(share, "provider", "left").select(
        "provider", F.coalesce("p95", F.lit(MISSING)).alias("p95"), F.coalesce("err", F.lit(0.0)).alias("err")
    )


def hitl_resolutions(reviews: DataFrame) -> DataFrame:
    """Reviews per (tenant, lower-cased resolution); a missing resolution counts as ``ack``."""
    res = F.lower(F.coalesce(F.nullif(tx.strip(F.col("resolution")), F.lit("")), F.lit("ack")))
    return reviews.groupBy("tenant", res.alias("resolution")).agg(F.count("*").alias("n"))


def ab_decisions(log: DataFrame, assignment: DataFrame, rerank_default: bool = False) -> DataFrame:
    """Requests per (tenant, model variant, rerank flag); only A and B are variants, the default is A."""
    joined = log.select("tenant").groupBy("tenant").agg(F.count("*").alias("n")).join(assignment, "tenant", "left")
    return joined.select(
        "tenant", F.when(F.col("llm").isin("A", "B"), F.col("llm")).otherwise("A").alias("variant"),
        F.coalesce(F.lower("rerank") == "true", F.lit(rerank_default)).alias("rerank"), "n",
    )


def replication_lag(writes: DataFrame) -> DataFrame:
    """Seconds the secondary's last write lies behind the primary's; 0 if either never wrote."""
    last = writes.agg(
        F.max(F.when(F.col("role") == "primary", sc.epoch(F.col("ts")))).alias("p"),
        F.max(F.when(F.col("role") == "secondary", sc.epoch(F.col("ts")))).alias("s"),
    )
    return last.select(F.coalesce(F.greatest(F.lit(0).cast("long"), F.col("p") - F.col("s")), F.lit(0).cast("long")).alias("lag_seconds"))


def usage_cost(log: DataFrame) -> DataFrame:
    """Tokens and USD per tenant, summed in millionths of a dollar."""
    return log_tokens(log).groupBy("tenant").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("cost_micro") / F.lit(1e6)).alias("cost_usd"),
    )


def cost_report(log: DataFrame) -> DataFrame:
    """Daily tokens and USD per tenant."""
    return log_tokens(log).groupBy(F.to_date("ts").alias("day"), "tenant").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("cost_micro") / F.lit(1e6)).alias("cost_usd"),
    )


def usage_today(log: DataFrame, limit: int) -> DataFrame:
    """Requests per (tenant, UTC day) beside the daily limit."""
    return log.groupBy("tenant", F.to_date("ts").alias("day")).agg(F.count("*").alias("used")).withColumn("limit", F.lit(limit))


def tenant_list(*tables: DataFrame) -> DataFrame:
    """Every tenant named by any of the tables, sorted."""
    out = tables[0].select("tenant").distinct()
    for t in tables[1:]:
        out = out.unionByName(t.select("tenant").distinct())
    return out.filter(F.coalesce("tenant", F.lit("")) != "").distinct().orderBy("tenant")


def audit_rows(answers: DataFrame) -> DataFrame:
    """Audit record per answer: time, tenant, lengths and the cited sources."""
    return answers.select(
        "ts", "tenant", F.length(F.coalesce("query", F.lit(""))).cast("long").alias("query_len"),
        F.length(F.coalesce("answer", F.lit(""))).cast("long").alias("answer_len"),
        F.transform("sources", lambda s: F.coalesce(s["source"], F.lit(""))).alias("sources"),
    )


def export_answer(answers: DataFrame, fmt: str = "markdown") -> DataFrame:
    """Answer with numbered citations as markdown, or as a JSON document."""
    if fmt == "markdown":
        refs = F.transform(
            "sources",
            lambda s, i: F.concat(
                (i + 1).cast("string"), F.lit(". "), F.coalesce(s["source"], F.lit("")),
                F.when(s["page"].isNotNull(), F.concat(F.lit(" (p."), s["page"].cast("string"), F.lit(")"))).otherwise(""),
            ),
        )
        content = F.array_join(F.concat(F.array(F.col("answer"), F.lit(""), F.lit("References:")), refs), "\n")
    else:
        cited = F.transform("sources", lambda s: F.struct(F.coalesce(s["source"], F.lit("")).alias("source"), s["page"].alias("page")))
        content = F.to_json(F.struct("answer", cited.alias("citations")), {"ignoreNullFields": "false"})
    return answers.withColumn("format", F.lit(fmt)).withColumn("content", content)
