"""Predicates and filters over chunks, results and queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tx

from siftwell.functions import scalars as sc

# Fixed value: longest accepted query.
MAX_QUERY_CHARS = 4000


@dataclass(frozen=True)
class Filters:
    """A metadata filter; empty parts do not constrain."""

    sources: Sequence[str] = ()
    doc_type: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    tenant: str | None = None


def predicate(df: DataFrame, f: Filters, multitenant: bool = True, date: str = "date") -> Column:
    """The filter as one expression. Plain comparisons on columns reach the Parquet scan and partitions."""
    parts: list[Column] = []
    if f.sources:
        parts.append(F.col("source").isin(list(f.sources)))
    if f.doc_type:
        parts.append(F.col("doc_type") == f.doc_type)
    if f.date_from or f.date_to:
        day = F.col(date) if dict(df.dtypes)[date] == "date" else sc.iso_day(F.col(date))
        if f.date_from:
            parts.append(day >= F.try_to_date(F.lit(f.date_from)))
        if f.date_to:
            parts.append(day <= F.try_to_date(F.lit(f.date_to)))
    if multitenant and f.tenant:
        parts.append(F.col("tenant") == f.tenant)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filters(df: DataFrame, f: Filters, multitenant: bool = True, date: str = "date") -> DataFrame:
    """Rows passing the filter; a missing or invalid date fails a date bound, as does an invalid bound."""
    return df.filter(predicate(df, f, multitenant, date))


def refilter(results: DataFrame) -> DataFrame:
    """Results against the filter columns of their own row: f_sources, f_doc_type, f_date_from, f_date_to (dates).

    NULL or an empty list means no constraint; a missing date fails a date bound.
    """
    ok = (
        (F.coalesce(F.size("f_sources"), F.lit(0)) <= 0) | F.coalesce(F.array_contains("f_sources", F.col("source")), F.lit(False))
    ) & (F.col("f_doc_type").isNull() | (F.col("f_doc_type") == "") | F.coalesce(F.col("doc_type") == F.col("f_doc_type"), F.lit(False)))
    ok = ok & (F.col("f_date_from").isNull() | F.coalesce(F.col("date") >= F.col("f_date_from"), F.lit(False)))
    ok = ok & (F.col("f_date_to").isNull() | F.coalesce(F.col("date") <= F.col("f_date_to"), F.lit(False)))
    return results.filter(ok)


def exclude_denied(df: DataFrame, deny: DataFrame, source: str = "source") -> DataFrame:
    """Rows whose source is not on the denylist."""
    return df.join(deny.select(F.col("source").alias("__deny")).distinct(), F.col(source) == F.col("__deny"), "left_anti")


def allow_only(df: DataFrame, allowed: DataFrame, source: str = "source") -> DataFrame:
    return df.join(allowed.select(F.col("source").alias("__ok")).distinct(), F.col(source) == F.col("__ok"), "left_semi")


def denylist_size(deny: DataFrame) -> DataFrame:
    return deny.agg(F.countDistinct("source").alias("denied"))


def enforce_tenant(queries: DataFrame, caller: str = "caller_tenant") -> DataFrame:
    """The caller's tenant replaces whatever tenant the query asked for."""
    return queries.withColumn("tenant", F.col(caller))


def valid_queries(df: DataFrame, query: str = "query", max_chars: int = MAX_QUERY_CHARS) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): stripped queries of 1 to ``max_chars`` characters, and the others with a ``reason``."""
    rows = df.withColumn(query, tx.strip(F.coalesce(F.col(query), F.lit(""))))
    size = F.length(F.col(query))
    return rows.filter(size.between(1, max_chars)), rows.filter(~size.between(1, max_chars)).withColumn("reason", F.when(size == 0, "empty_query").otherwise("query_too_long"))


def policy_hints(queries: DataFrame, policy: DataFrame) -> DataFrame:
    """Filters implied by the tenant's policy: allowed sources, requested or first allowed doc type and region."""
    pol = policy.select("tenant", "allowed_sources", "allowed_doc_types", "residency")
    return queries.join(pol, "tenant", "left").withColumn(
        "f_sources", F.when(F.size("allowed_sources") > 0, F.col("allowed_sources"))
    ).withColumn(
        "f_doc_type",
        F.when(F.size("allowed_doc_types") > 0, F.coalesce(F.nullif(F.col("doc_type"), F.lit("")), F.try_element_at("allowed_doc_types", F.lit(1))))
        .otherwise(F.col("doc_type")),
    ).withColumn(
        "f_region",
        F.when(F.size("residency") > 0, F.coalesce(F.nullif(F.col("region"), F.lit("")), F.try_element_at("residency", F.lit(1)))),
    ).drop("allowed_sources", "allowed_doc_types", "residency")


def route_collection(queries: DataFrame, routes: DataFrame, default: str = "default") -> DataFrame:
    """Collection per query: route of ``tenant:doc_type``, else of the tenant, else the default (lower-cased keys)."""
    tenant = F.lower(F.when(F.coalesce("tenant", F.lit("")) == "", "__default__").otherwise(F.col("tenant")))
    kind = F.lower(F.coalesce("doc_type", F.lit("")))
    exact = routes.select(F.col("route_key").alias("__k1"), F.col("collection").alias("__c1"))
    broad = routes.select(F.col("route_key").alias("__k2"), F.col("collection").alias("__c2"))
    return (
        queries.join(exact, F.when(kind == "", tenant).otherwise(F.concat(tenant, F.lit(":"), kind)) == F.col("__k1"), "left")
        .join(broad, tenant == F.col("__k2"), "left")
        .withColumn("collection", F.coalesce(F.nullif("__c1", F.lit("")), F.nullif("__c2", F.lit("")), F.lit(default)))
        .drop("__k1", "__c1", "__k2", "__c2")
    )


def in_sample(rate: float, key: str, seed: int = 0) -> Column:
    """Whether a row's key falls into a sample of ``rate`` (clamped to 0..1): a hash that any engine can compute."""
    bound = int(round(max(0.0, min(1.0, rate)) * 1_000_000))
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") % 1_000_000 < bound


def sample_stable(df: DataFrame, rate: float, key: str, seed: int = 0) -> DataFrame:
    """Deterministic sample by key hash; the same key is always in or out."""
    return df.filter(in_sample(rate, key, seed))
