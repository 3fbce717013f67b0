"""Feedback: append, export, summary and the helpful-rate gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.operators import ordered as od

# Report sizes and gate settings.
TOP, GATE_HELPFUL = 10, 0.55


def append_feedback(df: DataFrame, as_of: Column) -> DataFrame:
    """One row per submission: missing lists become empty, ``hallucinated`` stays NULL, ``ts`` is filled in."""
    present = set(df.columns)

    def col(name: str, kind: str) -> Column:
        return (F.col(name) if name in present else F.lit(None)).cast(kind)

    def listing(name: str) -> Column:
        return F.coalesce(col(name, "array<string>"), F.array().cast("array<string>")).alias(name)

    return df.select(
        col("tenant", "string").alias("tenant"),
        col("helpful", "boolean").alias("helpful"),
        col("reason", "string").alias("reason"),
        col("query", "string").alias("query"),
        col("answer", "string").alias("answer"),
        listing("clicked_sources"),
        col("hallucinated", "boolean").alias("hallucinated"),
        col("style_score", "int").alias("style_score"),
        listing("tags"),
        F.coalesce(col("ts", "timestamp"), as_of).alias("ts"),
    )


def newest_per_tenant(fb: DataFrame, limit: int | None, order: str, tail: str = "tenant", tenant: str | None = None) -> DataFrame:
    """Newest rows (all without a limit): per tenant, or (``global``) the newest of all tenants taken before any tenant filter."""
    if limit is None:
        return fb if tenant is None else fb.filter(F.col("tenant") == tenant)
    by = [F.col("ts").desc(), F.col(order).desc()]
    if tail == "global":
        kept = od.keep_latest(fb, limit, by)
        return kept if tenant is None else kept.filter(F.col("tenant") == tenant)
    scope = fb if tenant is None else fb.filter(F.col("tenant") == tenant)
    return od.keep_latest(scope, limit, by, ["tenant"])


def feedback_rates(rows: DataFrame) -> DataFrame:
    """Count, helpful and hallucinated share (only TRUE counts) and mean style score per tenant."""
    n = F.count("*")
    return rows.groupBy("tenant").agg(
        n.alias("count"),
        (F.count_if("helpful") / n).alias("helpful_rate"),
        (F.count_if("hallucinated") / n).alias("hallucinated_rate"),
        F.avg("style_score").alias("avg_style_score"),
    )


def _top_values(values: DataFrame, name: str, top: int) -> DataFrame:
    counted = values.filter(F.col(name) != "").groupBy("tenant", name).agg(F.count("*").alias("n"))
    w = Window.partitionBy("tenant").orderBy(F.col("n").desc(), name)
    ranked = counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select("tenant", F.lit(name).alias("kind"), F.col(name).alias("value"), "n", "rank")


def top_feedback_values(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Most frequent reasons and tags per tenant (trimmed, empty ones dropped; ties by text)."""
    reasons = rows.select("tenant", tx.strip(F.coalesce("reason", F.lit(""))).alias("reason"))
    tags = rows.select("tenant", F.explode("tags").alias("tag")).select("tenant", tx.strip(F.col("tag")).alias("tag"))
    return _top_values(reasons, "reason", top).unionByName(_top_values(tags, "tag", top))


def feedback_summary(fb: DataFrame, tenants: DataFrame, limit: int | None = None, order: str = "doc_id", tail: str = "tenant", top: int = TOP) -> DataFrame:
    """Rates plus top reasons and tags per tenant; tenants without feedback show count 0 and NULL rates."""
    rows = newest_per_tenant(fb, limit, order, tail)
    tops = top_feedback_values(rows, top)

    def listed(kind: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value", "n"))))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["value"], F.lit("="), p["n"].cast("string"))), ",")

    lists = tops.groupBy("tenant").agg(listed("reason").alias("top_reasons"), listed("tag").alias("top_tags"))
    return (
        tenants.select("tenant").distinct().join(feedback_rates(rows), "tenant", "left").join(lists, "tenant", "left")
        .select(
            "tenant", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "helpful_rate", "hallucinated_rate", "avg_style_score",
            F.coalesce("top_reasons", F.lit("")).alias("top_reasons"), F.coalesce("top_tags", F.lit("")).alias("top_tags"),
        )
    )


def export_feedback(fb: DataFrame, limit: int | None = None, tenant: str | None = None, order: str = "doc_id", tail: str = "global") -> DataFrame:
    """Training rows (tenant, helpful, reason, ts) of the newest feedback, ready for a JSON-lines sink."""
    rows = newest_per_tenant(fb, limit, order, tail, tenant)
    return rows.select("tenant", F.coalesce("helpful", F.lit(False)).alias("helpful"), "reason", "ts")


def rerank_canary(fb: DataFrame, window: int | None = None, threshold: float = GATE_HELPFUL, order: str = "doc_id") -> DataFrame:
    """Per tenant whether reranking stays on: helpful share of all rows, or the newest ``window``, at or above the threshold."""
    rows = newest_per_tenant(fb, window, order)
    return rows.groupBy("tenant").agg(
        F.count("*").alias("count"), (F.count_if("helpful") / F.count("*")).alias("helpful_rate")
    ).withColumn("enable", F.col("helpful_rate") >= threshold)


def canary_history(decisions: DataFrame, as_of: Column) -> DataFrame:
    """The row that each decision leaves in the history."""
    return decisions.select("tenant", "enable", "helpful_rate", "count", as_of.alias("ts"))
