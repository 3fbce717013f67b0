"""Rates, quantiles, ratios, alerts and objectives over an event table.

Every aggregate groups by a time window, so one busy label is spread over its windows, and counts combine on the
map side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators import ordered as od

# Histogram bucket bounds in seconds.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

# Objectives.
SLO = {"availability": 0.999, "p95_s": 1.5, "p99_s": 3.0, "error_rate": 0.005}


def window_start(seconds: int, ts: str = "ts") -> Column:
    """Start (epoch seconds) of the tumbling window holding ``ts``."""
    return (od.time_bucket(ts, seconds) * seconds).alias("window_start")


def rate(df: DataFrame, by: Sequence[str] = (), seconds: int = 300, where: Column | None = None) -> DataFrame:
    """Events per second and tumbling window."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(window_start(seconds), *by).agg((F.count("*") / F.lit(float(seconds))).alias("rate"))


def increase(df: DataFrame, value: Column, by: Sequence[str] = (), seconds: int = 300) -> DataFrame:
    """Sum of ``value`` per tumbling window."""
    return df.groupBy(window_start(seconds), *by).agg(F.sum(value).alias("increase"))


def total(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias("total"))


def histogram_quantile(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), seconds: int | None = 300, bounds: Sequence[float] = tuple(BOUNDS)
) -> DataFrame:
    """Quantiles from bucket counts, linear inside the bucket; beyond the last bound the last bound is returned.

    Only counts per bucket travel, so cost does not grow with the number of observations per group.
    """
    edges = [float(b) for b in bounds]
    bucket = F.when(F.col(value) <= edges[0], 0)
    for i, b in enumerate(edges[1:], start=1):
        bucket = bucket.when(F.col(value) <= b, i)
    keyed = df.filter(F.col(value).isNotNull()).withColumn("__b", bucket.otherwise(len(edges)))
    keys = list(by)
    if seconds is not None:
        keyed = keyed.withColumn("window_start", window_start(seconds))
        keys = ["window_start", *keys]
    counts = keyed.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("__cum", F.sum("__c").over(upto)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    at = cum.withColumn("quantile", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("__r", F.col("quantile") * F.col("__n"))
    hit = at.filter((F.col("__cum") >= F.col("__r")) & (F.col("__cum") - F.col("__c") < F.col("__r")))
    low = F.when(F.col("__b") == 0, 0.0).otherwise(F.element_at(F.array(*[F.lit(e) for e in edges]), F.greatest(F.col("__b"), F.lit(1))))
    high = F.element_at(F.array(*[F.lit(e) for e in edges]), F.least(F.col("__b") + 1, F.lit(len(edges))))
    inside = low + (high - low) * (F.col("__r") - (F.col("__cum") - F.col("__c"))) / F.col("__c")
    return hit.select(*keys, "quantile", F.when(F.col("__b") == len(edges), F.lit(edges[-1])).otherwise(inside).alias("value"))


def value_sketches(df: DataFrame, value: str, by: Sequence[str] = (), seconds: int = 300, error: float = 0.01) -> DataFrame:
    """Per tumbling window counts of values in bins whose bounds grow by a constant factor: ``window_start``, keys, ``bin, n``.

    Sketches of any windows merge by adding counts, and quantiles read from them miss the true ones by at most ``error`` of their value.
    Values up to 0 share a bin (null), of value 0; null values are left out. A window's rows are bounded by the range of its values.
    """
    bin_ = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value).cast("double")) / F.lit(math.log((1 + error) / (1 - error)))).cast("int"))
    return df.filter(F.col(value).isNotNull()).groupBy(window_start(seconds), *by, bin_.alias("bin")).agg(F.count("*").alias("n"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = (), span: int = 86400, error: float = 0.01) -> DataFrame:
    """Nearest-rank quantiles of spans of ``span`` seconds from the sketches of the windows in them: ``span_start``, keys, ``p, n, value``."""
    keys = ["span_start", *by]
    start = (F.floor(F.col("window_start") / span) * span).cast("long").alias("span_start")
    merged = sketches.groupBy(start, *by, "bin").agg(F.sum("n").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cum = merged.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = cum.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    need = F.bround(F.col("p") * (F.col("n") - 1)).cast("long") + 1
    hit = at.filter((F.col("upto") >= need) & (F.col("upto") - F.col("c") < need))
    growth = (1 + error) / (1 - error)
    return hit.select(*keys, "p", "n", F.coalesce(2 * F.pow(F.lit(growth), F.col("bin")) / (growth + 1), F.lit(0.0)).alias("value"))


def ratio(df: DataFrame, part: Column, whole: Column | None = None, by: Sequence[str] = (), seconds: int = 300) -> DataFrame:
    """Share of events matching ``part`` among those matching ``whole`` per window; an empty whole gives 0."""
    rows = df if whole is None else df.filter(whole)
    return rows.groupBy(window_start(seconds), *by).agg(
        (F.count_if(part) / F.greatest(F.count("*"), F.lit(1))).alias("ratio"), F.count("*").alias("n")
    )


def max_over_time(df: DataFrame, value: str, by: Sequence[str] = (), seconds: int = 300, slide: int | None = None) -> DataFrame:
    """Largest value per window; with ``slide`` the windows overlap (values are first reduced per slide)."""
    if slide is None or slide == seconds:
        return df.groupBy(window_start(seconds), *by).agg(F.max(value).alias("max_value"))
    if seconds % slide:
        raise ValueError("the window must be a multiple of the slide")
    # Reduce to one row per slide first; each of those then joins the seconds/slide windows that cover it.
    small = df.groupBy(od.time_bucket("ts", slide).alias("__s"), *by).agg(F.max(value).alias("__m"))
    spread = small.withColumn("__w", F.explode(F.sequence(F.col("__s") - (seconds // slide - 1), F.col("__s"))))
    return spread.groupBy((F.col("__w") * slide).alias("window_start"), *by).agg(F.max("__m").alias("max_value"))


def alert_spans(windows: DataFrame, breach: Column, seconds: int, hold: int, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive breaching windows lasting at least ``hold`` seconds.

    ``windows`` has one row per ``window_start`` (epoch seconds) and label, so it is already an aggregate.
    """
    bad = windows.filter(breach).withColumn("__label", F.lit(0))
    w = Window.partitionBy("__label", *by).orderBy("window_start")
    islands = bad.withColumn("__island", F.col("window_start") - F.row_number().over(w) * seconds)
    return (
        islands.groupBy(*by, "__island")
        .agg(F.min("window_start").alias("span_start"), (F.max("window_start") + seconds).alias("span_end"), F.count("*").alias("windows"))
        .withColumn("duration", F.col("span_end") - F.col("span_start"))
        .filter(F.col("duration") >= hold)
        .drop("__island")
    )


def trailing(small: DataFrame, values: Sequence[str], step: int, span: int, by: Sequence[str] = ()) -> DataFrame:
    """Sums of ``values`` over the ``span`` seconds that end with each window of ``step`` seconds.

    Each window hands its sums to the windows that look back on it, so nothing is ordered in one task.
    """
    spread = small.withColumn("window_start", F.explode(F.sequence(F.col("window_start"), F.col("window_start") + (span - step), F.lit(step).cast("long"))))
    return spread.groupBy("window_start", *by).agg(*[F.sum(v).alias(v) for v in values])


def burn_rate(
    df: DataFrame, bad: Column, fast: int = 300, slow: int = 3600, fast_limit: float = 0.1, slow_limit: float = 0.05, by: Sequence[str] = (),
    fast_hold: int = 300, slow_hold: int = 3600,
) -> DataFrame:
    """Per short window its share of ``bad`` events and that of the long window that ends with it.

    ``fast_burn`` and ``slow_burn`` say which exceeds its limit, ``burning`` whether both do, ``fast_alert`` and ``slow_alert``
    whether the excess has lasted through every window of the hold time; a window without events ends it.
    """
    small = df.groupBy(window_start(fast), *by).agg(F.count_if(bad).alias("__bad"), F.count("*").alias("__n"))
    large = trailing(small, ["__bad", "__n"], fast, slow, by).withColumnsRenamed({"__bad": "__sb", "__n": "__sn"})
    rows = small.join(large, ["window_start", *by]).withColumn("fast_ratio", F.col("__bad") / F.col("__n")).withColumn("slow_ratio", F.col("__sb") / F.col("__sn"))
    rows = rows.withColumn("fast_burn", F.col("fast_ratio") > fast_limit).withColumn("slow_burn", F.col("slow_ratio") > slow_limit)
    rows = rows.drop("__bad", "__n", "__sb", "__sn").withColumn("burning", F.col("fast_burn") & F.col("slow_burn"))
    for kind, hold in (("fast", fast_hold), ("slow", slow_hold)):
        hot = rows.select("window_start", *by, F.col(f"{kind}_burn").cast("int").alias("__hot"))
        lasted = trailing(hot, ["__hot"], fast, max(fast, hold), by)
        rows = rows.join(lasted, ["window_start", *by]).withColumn(f"{kind}_alert", F.col("__hot") >= max(1, hold // fast)).drop("__hot")
    return rows


def slo_attainment(log: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Availability, p95/p99 latency and 5xx share per month against their targets."""
    t = {**SLO, **(targets or {})}
    rows = log.withColumn("month", F.date_format("ts", "yyyy-MM"))
    good = F.col("status").between(200, 299) | (F.col("status").between(400, 499) & (F.col("status") != 429))
    shares = rows.groupBy("month").agg(
        F.count("*").alias("requests"), (F.count_if(good) / F.count("*")).alias("availability"),
        (F.count_if(F.col("status") >= 500) / F.count("*")).alias("error_rate"),
    )
    pct = od.rank_percentiles(rows, ["month"], "latency_s", [0.95, 0.99]).groupBy("month").agg(
        F.max(F.when(F.col("p") == 0.95, F.col("pctl"))).alias("p95_s"), F.max(F.when(F.col("p") == 0.99, F.col("pctl"))).alias("p99_s")
    )
    return shares.join(pct, "month", "left").withColumn(
        "met",
        (F.col("availability") >= t["availability"]) & (F.col("error_rate") <= t["error_rate"])
        & (F.col("p95_s") <= t["p95_s"]) & (F.col("p99_s") <= t["p99_s"]),
    )


def request_durations(events: DataFrame) -> DataFrame:
    """Start and end of each request from its two log rows; one shuffle with map-side combine instead of a self join.

    ``events``: request_id, event (request_start/request_end), ts. Requests missing either row are left out.
    """
    def at(kind: str) -> Column:
        return F.when(F.col("event") == kind, F.col("ts"))

    return (
        events.groupBy("request_id")
        .agg(F.min(at("request_start")).alias("start_ts"), F.max(at("request_end")).alias("end_ts"))
        .filter(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
        .withColumn("duration_ms", F.floor((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000).cast("long"))
    )
