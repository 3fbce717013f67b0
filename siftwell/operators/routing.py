"""Tenant configuration over defaults, tiers, and provider routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.usage import MISSING
from siftwell.session import materialize

# Tier limits.
TIER_COLUMNS = ["rate_per_min", "concurrent_max", "k_min", "k_max", "fetch_min", "fetch_max", "daily_usd_cap"]
TIERS = {
    "free": (60, 2, 4, 10, 10, 20, 5.0),
    "pro": (300, 8, 4, 20, 10, 50, 50.0),
    "enterprise": (1200, 32, 4, 32, 10, 80, 500.0),
}
DEFAULT_TIER = "pro"
DEFAULT_OBJECTIVE = "balanced"


def with_defaults(df: DataFrame, config: DataFrame, defaults: dict[str, object], key: str = "tenant") -> DataFrame:
    """Columns of ``config`` joined on ``key``; a missing row or value falls back to its default."""
    cfg = config.select(key, *[F.col(c).alias(f"__cfg_{c}") for c in defaults if c in config.columns])
    out = df.join(cfg, key, "left")
    for name, value in defaults.items():
        lit = F.array(*[F.lit(v) for v in value]).cast("array<string>") if isinstance(value, (list, tuple)) else F.lit(value)
        have = f"__cfg_{name}"
        out = out.withColumn(name, F.coalesce(F.col(have), lit) if have in out.columns else lit).drop(have)
    return out


def with_limits(df: DataFrame, tiers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add tier and limits to rows with a tenant: its tier (unknown ones count as pro) with per-tier overrides on top.

    ``tiers``: tenant, tier. ``overrides``: tier and any of the limit columns.
    """
    tier = F.lower(F.coalesce(F.nullif("tier", F.lit("")), F.lit(DEFAULT_TIER)))
    out = df.join(tiers, "tenant", "left").withColumn("tier", tier)
    names: list[str] = []
    if overrides is not None:
        names = [c for c in TIER_COLUMNS if c in overrides.columns]
        out = out.join(overrides.select("tier", *[F.col(c).alias(f"__o_{c}") for c in names]), "tier", "left")
    for i, name in enumerate(TIER_COLUMNS):
        value = F.lit(TIERS[DEFAULT_TIER][i])
        for t, limits in TIERS.items():
            value = F.when(F.col("tier") == t, F.lit(limits[i])).otherwise(value)
        kind = "double" if name == "daily_usd_cap" else "int"
        out = out.withColumn(name, F.coalesce(F.col(f"__o_{name}").cast(kind), value) if name in names else value)
    return out.drop(*[f"__o_{c}" for c in names])


def tier_limits(tenants: DataFrame, tiers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Tier and limits per tenant."""
    return with_limits(tenants.select("tenant").distinct(), tiers, overrides).select("tenant", "tier", *TIER_COLUMNS)


def tenant_summaries(limits: DataFrame) -> DataFrame:
    """One JSON document per tenant with its tier and limits."""
    doc = F.struct("tenant", "tier", F.struct(*TIER_COLUMNS).alias("limits"))
    return limits.select("tenant", F.to_json(doc).alias("summary"))


def router_policy(tenants: DataFrame, policies: DataFrame, allowed: list[str]) -> DataFrame:
    return with_defaults(tenants, policies, {"objective": DEFAULT_OBJECTIVE, "allowed_providers": allowed})


def model_costs(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """Prompt and completion price per (provider, model), NULL where none is set."""
    return pairs.join(costs, ["provider", "model"], "left")


def route_provider(requests: DataFrame, policy: DataFrame, health: DataFrame, costs: DataFrame, model: str, cheap: str, quality: str, fallback: str = "default") -> DataFrame:
    """Provider, model and reason per request; ``fallback`` serves tenants that allow none.

    ``policy`` per tenant: objective, allowed_providers, max_p95_ms, max_error_rate_5m, max_prompt_cost_per_1k,
    doc_type_overrides (map of doc type to provider). ``health``: provider, p95, err. ``costs``: provider, model,
    prompt. Providers that meet the objectives come first, then the smallest metric, then policy order.

    A decision depends on (tenant, doc type) only, so it is made once per distinct pair and joined back.
    """
    kind = F.lower(F.nullif("doc_type", F.lit("")))
    asked = requests.withColumn("__kind", kind)
    wide = F.array(F.lit(fallback))
    pairs = asked.select("tenant", "__kind").distinct().join(policy, "tenant", "left").withColumn(
        "__obj", F.lower(F.coalesce(F.nullif("objective", F.lit("")), F.lit(DEFAULT_OBJECTIVE)))
    ).withColumn("__allowed", F.when(F.size("allowed_providers") > 0, F.col("allowed_providers")).otherwise(wide))
    wish = F.try_element_at("doc_type_overrides", F.col("__kind"))
    ordered = F.when(
        F.coalesce(F.array_contains("__allowed", wish), F.lit(False)),
        F.concat(F.array(wish), F.filter("__allowed", lambda p: p != wish)),
    ).otherwise(F.col("__allowed"))
    cands = pairs.withColumn("__order", ordered).select(
        "tenant", "__kind", "__obj", "max_p95_ms", "max_error_rate_5m", "max_prompt_cost_per_1k", F.posexplode("__order").alias("__pos", "provider")
    )
    price = costs.filter(F.col("model") == model).select("provider", F.col("prompt").alias("__cost"))
    cands = cands.join(health, "provider", "left").join(price, "provider", "left").withColumn(
        "__p95", F.coalesce("p95", F.lit(MISSING))
    ).withColumn("__err", F.coalesce("err", F.lit(0.0))).withColumn("__cost", F.coalesce("__cost", F.lit(MISSING)))

    def within(value: Column, bound: str) -> Column:
        return F.col(bound).isNull() | (value <= F.col(bound))

    ok = within(F.col("__p95") * 1000, "max_p95_ms") & within(F.col("__err"), "max_error_rate_5m") & within(F.col("__cost"), "max_prompt_cost_per_1k")
    metric = (
        F.when(F.col("__obj") == "latency", F.col("__p95")).when(F.col("__obj") == "cost", F.col("__cost"))
        .when(F.col("__obj") == "quality", F.col("__err")).otherwise(F.col("__p95") + F.col("__cost"))
    )
    w = Window.partitionBy("tenant", "__kind").orderBy(F.col("__ok").desc(), "__metric", "__pos")
    best = cands.withColumn("__ok", ok).withColumn("__metric", metric).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    known = F.when(F.col("__obj").isin("latency", "cost", "quality"), F.col("__obj")).otherwise("balanced")
    miss = F.when(known == "quality", F.lit("_slo_failover")).otherwise(F.lit("_slo_violation"))
    decided = best.select(
        F.col("tenant").alias("__t"), F.col("__kind").alias("__k"), F.col("provider").alias("routed_provider"),
        F.when(known.isin("latency", "cost"), cheap).when(known == "quality", quality).otherwise(model).alias("routed_model"),
        F.when(F.col("__ok"), known).otherwise(F.concat(known, miss)).alias("reason"),
    )
    # Written, the decisions have a known size: small ones are broadcast, so requests are not shuffled by tenant.
    decided = materialize(decided, "routes")
    return asked.join(decided, F.col("tenant").eqNullSafe(F.col("__t")) & F.col("__kind").eqNullSafe(F.col("__k")), "left").drop("__t", "__k", "__kind")
