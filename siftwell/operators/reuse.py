"""Answer reuse: which requests an earlier identical or similar request could have answered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions.frames import empty, plain
from siftwell.operators import ordered as od
from siftwell.session import materialize

# Lifetimes, threshold and index size.
TTL_SECONDS, NEGATIVE_TTL_SECONDS = 300, 15
THRESHOLD, NEWEST = 0.92, 200
BUCKET_SECONDS = 3600


def tenant_ttl(spec: str | None, default: int = TTL_SECONDS, tenant: str = "tenant") -> Column:
    """TTL of a row's tenant from ``"tenant:seconds,…"``, else the default."""
    if not spec or not spec.strip():
        return F.lit(default).cast("long")
    return F.coalesce(F.try_element_at(sc.parse_map(spec), F.col(tenant)).try_cast("long"), F.lit(default).cast("long"))


def with_namespace(log: DataFrame, bumps: DataFrame) -> DataFrame:
    """Add ``ns``: one plus the number of invalidations at or before the row's time.

    ``bumps`` holds ``ts``; an invalidation ends the life of every earlier entry.
    """
    bucket = od.time_bucket("ts", BUCKET_SECONDS)
    marks = bumps.select(F.col("ts").cast("timestamp").alias("ts")).groupBy("ts").agg(F.count("*").alias("n"))
    per_bucket = marks.groupBy(bucket.alias("__bucket")).agg(
        F.sort_array(F.collect_list(F.struct("ts", "n"))).alias("__marks"), F.sum("n").alias("__n")
    )
    # One row per hour of the log; the running count over hours is taken on these rows only.
    hours = log.select(bucket.alias("__bucket")).distinct().join(per_bucket, "__bucket", "full")
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    hours = materialize(hours.select("__bucket", "__marks", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "hours")
    here = F.aggregate(
        F.filter(F.coalesce("__marks", F.array().cast("array<struct<ts:timestamp,n:bigint>>")), lambda m: m["ts"] <= F.col("ts")),
        F.lit(0).cast("long"), lambda acc, m: acc + m["n"],
    )
    # The table of hours was written, so its size is known: it is broadcast if small and shuffled otherwise.
    return log.withColumn("__bucket", bucket).join(hours, "__bucket").withColumn("ns", F.lit(1) + F.col("__before") + here).drop(
        "__bucket", "__marks", "__before"
    )


def reuse_key(df: DataFrame, out: str = "reuse_key") -> DataFrame:
    """SHA-256 key over namespace, tenant, query and filters (doc_type stands for the filters of a log row)."""
    ns = F.col("ns") if "ns" in df.columns else F.lit(1)
    return df.withColumn(
        out, sc.request_key(F.col("doc_type").alias("f"), ns.alias("ns"), F.col("query").alias("q"), F.col("tenant").alias("tenant"))
    )


def seen_within_ttl(log: DataFrame, ttl: Column, keys: list[str], order: str = "request_id") -> DataFrame:
    """``hit``: an earlier row with the same keys lies less than ``ttl`` seconds back."""
    prev = od.previous(log, keys, ["ts", order], od.time_bucket("ts", BUCKET_SECONDS), "ts", "prev_ts")
    gap = F.unix_micros("ts") - F.unix_micros("prev_ts")
    return prev.withColumn("hit", F.coalesce(gap < ttl.cast("long") * 1_000_000, F.lit(False)))


def exact_reuse(log: DataFrame, ttl: Column | None = None) -> DataFrame:
    """Requests repeating an earlier (namespace, tenant, query, filters) within the TTL."""
    keys = ["tenant", "query", "doc_type"] + (["ns"] if "ns" in log.columns else [])
    return seen_within_ttl(log, ttl if ttl is not None else tenant_ttl(None), keys)


def negative_reuse(log: DataFrame, empty: Column, ttl: int = NEGATIVE_TTL_SECONDS) -> DataFrame:
    """``suppressed``: an earlier identical request got no answer less than ``ttl`` seconds back."""
    base = log.withColumn("__empty_ts", F.when(empty, F.col("ts")))
    prev = od.running(
        base, ["tenant", "query", "doc_type"], ["ts", "request_id"], od.time_bucket("ts", BUCKET_SECONDS),
        maxes={"__last": F.col("__empty_ts")}, inclusive=False,
    )
    gap = F.unix_micros("ts") - F.unix_micros("__last")
    return prev.withColumn("suppressed", F.coalesce(gap < ttl * 1_000_000, F.lit(False))).drop("__empty_ts", "__last")


def replay_reuse(log: DataFrame, keys: list[str], ttl: Column | None = None, order: str = "request_id") -> DataFrame:
    """Strict replay of a reuse table whose hits do not extend an entry's life, in whole seconds.

    A request is a hit while the last *miss* of its key is less than the TTL old. The rows are first reduced to
    one per key and second, so the sequential step sees at most one row per second of the log's span however hot
    the key; it is further cut at every pause of a TTL or more, after which the next request is always a miss.
    """
    life = ttl if ttl is not None else tenant_ttl(None)
    rows = log.withColumn("__second", sc.epoch(F.col("ts"))).withColumn("__ttl", life)
    seconds = rows.groupBy(*keys, "__second").agg(F.max("__ttl").alias("__ttl"), F.min(order).alias("__first"))
    runs = od.gap_sessions(
        seconds, keys, ["__second"], F.floor(F.col("__second") / BUCKET_SECONDS).cast("long"), F.col("__second"), F.col("__ttl"), "__run"
    )
    schema = runs.select(*keys, "__second", "__first").withColumn("__miss", F.lit(False)).schema
    names = [*keys, "__run"]

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by key, run and second; the state is one key and the end of its entry's life.
        current: tuple | None = None
        until = 0
        for frame in frames:
            columns = [frame[c].where(frame[c].notna(), None).tolist() for c in names]
            miss = []
            for key, second, life_of in zip(zip(*columns), frame["__second"].tolist(), frame["__ttl"].tolist()):
                if key != current or second >= until:
                    current, until = key, second + life_of
                    miss.append(True)
                else:
                    miss.append(False)
            yield plain(frame[[*keys, "__second", "__first"]]).assign(__miss=miss)

    # Every run is independent, so a hot key spreads over tasks; no run is held in memory.
    marks = runs.repartition(*names).sortWithinPartitions(*names, "__second").mapInPandas(replay, schema)
    state = marks.select(F.struct(*keys).alias("__k"), "__second", "__first", "__miss")
    return (
        rows.withColumn("__k", F.struct(*keys))
        .join(state, ["__k", "__second"])
        .withColumn("hit", ~(F.col("__miss") & (F.col(order) == F.col("__first"))))
        .drop("__k", "__second", "__ttl", "__miss", "__first")
    )


def semantic_reuse(
    queries: DataFrame, threshold: float = THRESHOLD, newest: int = NEWEST, ttl: int = TTL_SECONDS, qid: str = "qid",
    block: int = 2000, group: tuple[str, ...] = ("tenant",),
) -> DataFrame:
    """Best earlier query among the ``newest`` ones of the same group with cosine at or above ``threshold``.

    ``queries``: group columns, qid, ts, embedding; one row per distinct key. The index of a group empties
    when nothing was written for ``2 * ttl`` seconds. Ties go to the oldest entry. Each task gets ``block``
    queries plus the ``newest`` before them, so no task grows with its group and no pairs are emitted.
    """
    keys = list(group)
    bucket = od.time_bucket("ts", BUCKET_SECONDS)
    placed = od.gap_sessions(
        queries.select(*keys, qid, "ts", "embedding"), keys, ["ts", qid], bucket, F.unix_micros("ts"),
        F.lit(2 * ttl * 1_000_000).cast("long"), "__epoch", "__pos",
    )
    halo = od.with_halo(placed, "__pos", max(block, newest), newest)
    schema = queries.select(*keys, qid).withColumn("match_id", queries[qid]).withColumn("cosine", F.lit(0.0)).schema

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__pos").reset_index(drop=True)
        size = max(len(v) for v in frame["embedding"])
        m = np.zeros((len(frame), size))
        lengths = np.array([len(v) for v in frame["embedding"]])
        for i, v in enumerate(frame["embedding"]):
            m[i, : len(v)] = np.asarray(v, dtype=np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
        pos, epoch, home = (frame[c].to_numpy() for c in ("__pos", "__epoch", "home"))
        hits = []
        for i in np.nonzero(home)[0]:
            lo = int(np.searchsorted(pos, pos[i] - newest))
            if lo >= i:
                continue
            scores = np.round(m[lo:i] @ m[i], 6)
            scores[(epoch[lo:i] != epoch[i]) | (lengths[lo:i] != lengths[i])] = 0.0
            j = int(np.argmax(scores))
            if scores[j] > 0 and scores[j] >= threshold:
                hits.append((i, lo + j, float(scores[j])))
        if not hits:
            return empty([*keys, qid, "match_id", "cosine"])
        rows = [h[0] for h in hits]
        out = frame.loc[rows, [*keys, qid]].copy()
        out["match_id"] = frame[qid].to_numpy()[[h[1] for h in hits]]
        out["cosine"] = [h[2] for h in hits]
        return plain(out)

    return halo.drop("ts").groupBy(*keys, "block").applyInPandas(match, schema)


def reuse_ratio(hits: DataFrame, hit: str = "hit", by: str = "tenant") -> DataFrame:
    """Hits, misses and their ratio (0 when there were none) per tenant."""
    good = F.count_if(F.col(hit))
    return hits.groupBy(by).agg(
        good.alias("hits"), F.count_if(~F.col(hit)).alias("misses"),
        (good / F.greatest(F.count(F.col(hit)), F.lit(1))).alias("hit_ratio"),
    )
