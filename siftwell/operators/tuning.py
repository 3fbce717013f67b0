"""Tuning suggestions from recent signals and the plan for applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds.
LOW_HELPFUL, HIGH_HELPFUL, FEW_HALLUCINATIONS = 0.6, 0.85, 0.05
TROUBLE_SHARE, LOOKUP_SHARE, TYPE_SHARE = 0.3, 0.6, 0.5


def _suggestion(kind: str, action: str, reason: str, target: Column, metric: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(action).alias("action"), F.lit(reason).alias("reason"),
        target.cast("string").alias("target"), metric.cast("double").alias("metric"),
    )


def tuning_suggestions(tenants: DataFrame, rates: DataFrame, intents: DataFrame, volume: DataFrame) -> DataFrame:
    """One row per suggestion.

    ``rates``: tenant, helpful_rate, hallucinated_rate. ``intents``: tenant, intent, share. ``volume``: tenant,
    doc_type, count. All are per-tenant aggregates already.
    """
    mix = intents.groupBy("tenant").agg(
        F.coalesce(F.max(F.when(F.col("intent") == "troubleshoot", F.col("share"))), F.lit(0.0)).alias("trouble"),
        F.coalesce(F.max(F.when(F.col("intent") == "lookup", F.col("share"))), F.lit(0.0)).alias("lookup"),
    )
    per_type = volume.groupBy("tenant", "doc_type").agg(F.sum("count").alias("c"))
    everything = Window.partitionBy("tenant")
    ranked = per_type.withColumn("type_share", F.col("c") / F.sum("c").over(everything)).filter(F.col("doc_type").isNotNull())
    top = ranked.withColumn("rn", F.row_number().over(everything.orderBy(F.col("c").desc(), "doc_type"))).filter("rn = 1").select(
        "tenant", "doc_type", "type_share"
    )
    joined = tenants.select("tenant").distinct().join(rates, "tenant", "left").join(mix, "tenant", "left").join(top, "tenant", "left")
    few = F.col("hallucinated_rate").isNull() | (F.col("hallucinated_rate") < FEW_HALLUCINATIONS)
    none = F.lit(None)
    options = F.array(
        F.when(
            F.col("helpful_rate") < LOW_HELPFUL,
            _suggestion("router_policy", "consider_quality_objective", "low_helpful_rate", F.lit("quality"), F.col("helpful_rate")),
        ).when(
            (F.col("helpful_rate") > HIGH_HELPFUL) & few,
            _suggestion("router_policy", "consider_cost_or_latency_objective", "high_helpful_low_hallucinations", F.lit("cost"), F.col("helpful_rate")),
        ),
        F.when(
            F.col("trouble") > TROUBLE_SHARE,
            _suggestion("retrieval_depth", "increase_k_fetch_k", "high_troubleshoot_intent_share", none, F.col("trouble")),
        ).when(
            F.col("lookup") > LOOKUP_SHARE,
            _suggestion("retrieval_depth", "consider_reducing_k_for_lookup", "dominant_lookup_intent", none, F.col("lookup")),
        ),
        F.when(
            F.col("type_share") >= TYPE_SHARE,
            _suggestion("index_routing", "consider_dedicated_collection_for_doc_type", "dominant_doc_type_volume", F.col("doc_type"), F.col("type_share")),
        ),
    )
    return joined.select("tenant", F.explode(F.array_compact(options)).alias("s")).select("tenant", "s.*")


def tuning_plan(suggestions: DataFrame, policy: DataFrame, routes: DataFrame) -> DataFrame:
    """What applying each suggestion would change, or why it is skipped.

    ``policy``: tenant, objective. ``routes``: route_key, collection.
    """
    key = F.lower(F.concat("tenant", F.lit(":"), "target"))
    rows = suggestions.withColumn("route_key", F.when(F.col("kind") == "index_routing", key))
    rows = rows.join(policy.select("tenant", F.col("objective").alias("__old")), "tenant", "left")
    rows = rows.join(routes.select("route_key", F.col("collection").alias("__route")), "route_key", "left")
    is_router, is_route = F.col("kind") == "router_policy", F.col("kind") == "index_routing"
    skipped = (
        F.when(is_router & (F.lower(F.coalesce("__old", F.lit(""))) == F.lower("target")), "already_set")
        .when(is_route & (F.coalesce("__route", F.lit("")) != ""), "route_already_set")
        .when(~is_router & ~is_route, "not_applicable")
    )
    change = F.when(is_router, F.col("target")).when(is_route, F.replace(F.concat("tenant", F.lit("_"), "target"), F.lit(":"), F.lit("_")))
    return rows.select(
        "tenant", "kind", "target", "route_key", skipped.isNull().alias("applied"), skipped.alias("skip_reason"),
        F.when(skipped.isNull(), change).alias("new_value"), F.when(skipped.isNull() & is_router, F.col("__old")).alias("old_value"),
    )
