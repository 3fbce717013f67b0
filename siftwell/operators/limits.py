"""Rate limits, quotas, budgets and concurrency over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators import ordered as od

# Limits and prices.
RATE_LOCAL, RATE_DEFAULT = 60, 30
DAILY_QUOTA = 1000
TOKENS_PER_DOLLAR = 25000
DAILY_USD, WARN_FRACTION = 50.0, 0.8
# USD per 1000 prompt and completion tokens, in millionths of a dollar per token.
PROMPT_MICRO, COMPLETION_MICRO = 5, 15
BUCKET_SECONDS = 300

MINUTE, DAY = 60, 86400


def _positive(limit: int | str) -> Column:
    col = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return F.greatest(F.lit(1), col)


def rate_limit(log: DataFrame, limit: int | str = RATE_LOCAL, key: str = "user_id", order: str = "request_id") -> DataFrame:
    """Position of each request in its key's minute; beyond ``limit`` (a number or a column) it is rejected."""
    minutes = log.withColumn("__minute", od.time_bucket("ts", MINUTE))
    out = od.position(minutes, [key, "__minute"], ["ts", order], F.col("__minute"))
    return out.withColumn("rejected", F.col("n") > _positive(limit)).drop("__minute")


def daily_quota(log: DataFrame, limit: int | str = DAILY_QUOTA, key: str = "tenant", order: str = "request_id") -> DataFrame:
    """Position of each request in its key's UTC day; beyond ``limit`` it is rejected."""
    days = log.withColumn("day", F.to_date("ts"))
    out = od.position(days, [key, "day"], ["ts", order], od.time_bucket("ts", BUCKET_SECONDS))
    return out.withColumn("rejected", F.col("n") > _positive(limit))


def log_tokens(log: DataFrame) -> DataFrame:
    """Estimated prompt and completion tokens of each request, and its price in millionths of a dollar."""
    p = F.greatest(F.lit(1), F.floor(F.col("prompt_chars") / 4)).cast("long")
    c = F.greatest(F.lit(1), F.floor(F.col("answer_chars") / 4)).cast("long")
    return log.withColumn("prompt_tokens", p).withColumn("completion_tokens", c).withColumn(
        "cost_micro", F.col("prompt_tokens") * PROMPT_MICRO + F.col("completion_tokens") * COMPLETION_MICRO
    )


def budget_actions(
    log: DataFrame, cap: float | str, tokens_per_dollar: int = TOKENS_PER_DOLLAR, order: str = "request_id"
) -> DataFrame:
    """Action per request from the tenant's running spend of the UTC day, this request included.

    Above the cap the model is shifted down, above 1.2 times the cap the request is rejected. Tokens are summed as
    integers, so the result does not depend on summation order.
    """
    tokens = F.greatest(F.lit(1), F.floor((F.col("prompt_chars") + F.col("answer_chars")) / 4)).cast("long")
    days = log.withColumn("day", F.to_date("ts")).withColumn("tokens", tokens)
    run = od.running(days, ["tenant", "day"], ["ts", order], od.time_bucket("ts", BUCKET_SECONDS), {"running_tokens": F.col("tokens")})
    limit = (F.col(cap) if isinstance(cap, str) else F.lit(float(cap))).cast("double")
    spent = F.col("running_tokens") / F.lit(float(max(1, tokens_per_dollar)))
    return run.withColumn("spent_usd", spent).withColumn(
        "action", F.when(F.col("spent_usd") > limit * 1.2, "reject").when(F.col("spent_usd") > limit, "downshift").otherwise("allow")
    )


def budget_throttle(
    log: DataFrame, limit: float | str = DAILY_USD, warn: float = WARN_FRACTION, order: str = "request_id"
) -> DataFrame:
    """Throttle or cheap-model flag from the spend of the UTC day before each request."""
    days = log_tokens(log).withColumn("day", F.to_date("ts"))
    run = od.running(
        days, ["tenant", "day"], ["ts", order], od.time_bucket("ts", BUCKET_SECONDS), {"spent_micro": F.col("cost_micro")}, inclusive=False
    )
    cap = (F.col(limit) if isinstance(limit, str) else F.lit(float(limit))).cast("double")
    spent = F.col("spent_micro") / F.lit(1e6)
    return run.withColumn("spent_usd", spent).withColumn(
        "decision", F.when(F.col("spent_usd") >= cap, "throttle").when(F.col("spent_usd") >= cap * warn, "cheap").otherwise("allow")
    )


def concurrency_peak(intervals: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Peak number of requests in flight per tenant and bucket; ``intervals``: tenant, start_ts, end_ts.

    An end at the same instant as a start frees its slot first. Every bucket from a tenant's first start to its last
    end has a row: the level that it begins with counts, also where nothing starts or ends.
    """
    starts = intervals.select("tenant", F.col("start_ts").alias("ts"), F.lit(1).alias("step"))
    ends = intervals.select("tenant", F.col("end_ts").alias("ts"), F.lit(-1).alias("step"))
    steps = starts.unionByName(ends)
    bucket = od.time_bucket("ts", bucket_seconds)
    # A step of nothing opens each bucket, after what ends at that very instant.
    span = steps.groupBy("tenant").agg(F.min(bucket).alias("__a"), F.max(bucket).alias("__b"))
    opened = span.select("tenant", F.explode(F.sequence("__a", "__b")).alias("__o"))
    opened = opened.select("tenant", F.timestamp_seconds(F.col("__o") * bucket_seconds).alias("ts"), F.lit(0).alias("step"))
    level = od.running(steps.unionByName(opened), ["tenant"], ["ts", "step"], bucket, {"in_flight": F.col("step")})
    return level.withColumn("bucket", bucket).groupBy("tenant", "bucket").agg(F.max("in_flight").alias("peak"))
