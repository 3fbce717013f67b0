"""Policy tiers, output guardrails, soft deletes and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.operators import filters as fl
from siftwell.operators.routing import with_defaults

# Policy defaults.
POLICY_DEFAULTS: dict[str, object] = {
    "allowed_sources": [], "allowed_doc_types": [], "residency": [], "pii_tier": "redact", "break_glass": False,
}
GUARDRAIL_DEFAULTS: dict[str, object] = {"enable_pii_redaction": True, "enable_secret_redaction": False, "max_answer_chars": None}


def load_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    """The tenant's policy columns over the defaults."""
    return with_defaults(df, policies, POLICY_DEFAULTS)


def policy_post(df: DataFrame, answer: str = "answer", sources: str = "sources", override: str = "override") -> DataFrame:
    """Answer and sources after the PII tier (deny, mask, redact, allow) and the break-glass override.

    Rows carry pii_tier and break_glass; sources are structs with ``source`` and ``page``. Adds post_answer,
    post_sources and decision.
    """
    tier = F.lower(F.coalesce(F.nullif("pii_tier", F.lit("")), F.lit("redact")))
    decision = (
        F.when(F.coalesce(F.col(override) & F.col("break_glass"), F.lit(False)), "overridden")
        .when(tier == "deny", "denied").when(tier == "mask", "masked").when(tier == "redact", "redacted").otherwise("allowed")
    )
    raw = F.col(answer)
    out = df.withColumn("decision", decision)
    text = (
        F.when(F.col("decision") == "denied", F.lit(""))
        .when(F.col("decision") == "masked", tx.redact_contacts(raw, "MASKED"))
        .when(F.col("decision") == "redacted", tx.redact_contacts(raw, "REDACTED"))
        .when(F.col("decision") == "overridden", raw)
        .otherwise(F.coalesce(raw, F.lit("")))
    )
    hidden = F.transform(
        sources,
        lambda s: s.withField("source", F.when(F.coalesce(s["source"], F.lit("")) != "", F.lit("[MASKED_SOURCE]")).otherwise(s["source"])),
    )
    listed = F.when(F.col("decision") == "denied", F.slice(F.col(sources), 1, 0)).when(F.col("decision") == "masked", hidden).otherwise(F.col(sources))
    return out.withColumn("post_answer", text).withColumn("post_sources", listed)


def policy_simulate(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Filter hints and post-processing for hypothetical answers (tenant, doc_type, region, answer, sources, override).

    Sources may be plain strings.
    """
    if rows.schema["sources"].dataType.simpleString() == "array<string>":
        rows = rows.withColumn("sources", F.transform("sources", lambda s: F.struct(s.alias("source"), F.lit(None).cast("int").alias("page"))))
    hinted = fl.policy_hints(rows, policies)
    pol = policies.select("tenant", *[c for c in ("pii_tier", "break_glass") if c in policies.columns])
    done = policy_post(with_defaults(hinted, pol, {"pii_tier": "redact", "break_glass": False}))
    # No answer given: nothing to post-process.
    return done.withColumn("post_answer", F.when(F.col("answer").isNotNull(), F.col("post_answer"))).withColumn(
        "decision", F.when(F.col("answer").isNotNull(), F.col("decision"))
    )


def output_guardrails(df: DataFrame, text: str = "answer") -> DataFrame:
    """PII, then secrets, then length, each by its row's switch; ``guardrail_flags`` lists what changed, in that order."""
    given = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__g0", given)
    out = out.withColumn("__g1", F.when(F.col("enable_pii_redaction"), tx.redact_pii(F.col("__g0"))).otherwise(F.col("__g0")))
    out = out.withColumn("__g2", F.when(F.col("enable_secret_redaction"), tx.redact_secrets(F.col("__g1"))).otherwise(F.col("__g1")))
    long = F.coalesce((F.col("max_answer_chars") > 0) & (F.length("__g2") > F.col("max_answer_chars")), F.lit(False))
    out = out.withColumn("__long", long).withColumn(
        "guarded", F.when(F.col("__long"), F.substring(F.col("__g2"), F.lit(1), F.coalesce("max_answer_chars", F.lit(0)))).otherwise(F.col("__g2"))
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("__g1") != F.col("__g0"), F.lit("pii_redacted")),
            F.when(F.col("__g2") != F.col("__g1"), F.lit("secret_redacted")),
            F.when(F.col("__long"), F.lit("truncated")),
        )
    )
    return out.withColumn("guardrail_flags", flags).drop("__g0", "__g1", "__g2", "__long")


def input_guardrail(df: DataFrame, config: DataFrame, query: str = "query") -> DataFrame:
    """``matched``: the first block pattern of the row's tenant contained in the query; ``blocked`` when there is one."""
    out = df.join(config.select("tenant", "block_patterns"), "tenant", "left")
    return out.withColumn("matched", tx.blocked_pattern(F.col(query), F.col("block_patterns"))).withColumn(
        "blocked", F.col("matched").isNotNull()
    ).drop("block_patterns")


def soft_delete(deny: DataFrame, sources: DataFrame) -> DataFrame:
    return deny.select("source").union(sources.select("source")).filter(F.col("source") != "").distinct()


def soft_undelete(deny: DataFrame, sources: DataFrame) -> DataFrame:
    return deny.select("source").distinct().join(sources.select("source"), "source", "left_anti")


def retention_sweep(index: DataFrame, deny: DataFrame, days: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(new denylist, newly denied sources): sources whose latest date is ``days`` or more before ``as_of``.

    Zero days switches the sweep off. Sweeping twice changes nothing.
    """
    if days <= 0:
        return deny.select("source").distinct(), deny.select("source").limit(0)
    latest = index.filter(F.coalesce("source", F.lit("")) != "").groupBy("source").agg(F.max("date").alias("last_date"))
    old = latest.filter(F.col("last_date") <= F.date_sub(F.to_date(as_of), days)).select("source")
    return soft_delete(deny, old), old.join(deny.select("source"), "source", "left_anti")
