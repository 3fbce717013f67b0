"""Ordered per-key computations that survive hot keys.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. A key holding a third of the
data would then be the whole job. The helpers below split a key's timeline into buckets: rows are
windowed inside (key, bucket), per-bucket totals are pre-aggregated on the map side, and only those totals
are windowed per key. Should one bucket itself be too large, the whole order is cut into equal ranges of rows
instead. Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import materialize

_KEY, _BUCKET = "__key", "__bucket"

# Bucket of rows without a time: they sort first, as NULLs do.
_NO_TIME = -(2**63)

# Rows one task may have to order; a fuller (key, bucket) makes the split go by row ranges.
MAX_BUCKET_ROWS = 5_000_000


def time_bucket(ts: str | Column, seconds: int) -> Column:
    """Index of the fixed-width time bucket holding ``ts``."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def keep_latest(df: DataFrame, n: int, by: Sequence[str | Column], partition: Sequence[str] = ()) -> DataFrame:
    """Newest ``n`` rows, per ``partition`` if given. ``by`` must be a total order (newest first).

    Per partition this is a ranking filter, which Spark limits on the map side before the shuffle; globally
    it is a distributed top-n without a single-task window.
    """
    if not partition:
        return df.orderBy(*by).limit(n)
    w = Window.partitionBy(*partition).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # A struct key is never NULL itself, so rows with NULL key columns still join and group.
    return df.withColumn(_KEY, F.struct(*keys))


def _by_ranges(keyed: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows: int, limit: int) -> DataFrame:
    """The rows cut into ranges of about ``limit`` rows that follow keys, then order.

    Ranges are non-decreasing along each key; written, they stay the same whoever reads them again.
    """
    ranged = keyed.repartitionByRange(-(-rows // limit), *keys, *order).withColumn(_BUCKET, F.spark_partition_id().cast("long"))
    return materialize(ranged, "ranges")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    inclusive: bool = True,
    max_rows: int | None = None,
) -> DataFrame:
    """Running sums and maxima over ``keys`` in ``order``, up to (and with ``inclusive``, including) each row.

    ``bucket`` must be non-decreasing along ``order``. Sums start at 0, maxima at NULL. The totals per bucket are
    written first: they tell whether a bucket is overfull, and with their size known the small ones are broadcast,
    which leaves one shuffle of the rows.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    limit = max_rows or MAX_BUCKET_ROWS

    def valued(rows: DataFrame) -> DataFrame:
        for name, expr in {**sums, **maxes}.items():
            rows = rows.withColumn(f"__v_{name}", expr)
        return rows

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(_KEY, _BUCKET).agg(
            F.count("*").alias("__rows"),
            *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums],
            *[F.max(f"__v_{n}").alias(f"__t_{n}") for n in maxes],
        )

    keyed = valued(_keyed(df, keys))
    base = keyed.withColumn(_BUCKET, F.coalesce(bucket, F.lit(_NO_TIME)))
    totals = materialize(summed(base), "totals")
    size = totals.agg(F.max("__rows").alias("top"), F.sum("__rows").alias("all")).first()
    if (size["top"] or 0) > limit:
        base = _by_ranges(keyed, keys, order, size["all"], limit)
        totals = materialize(summed(base), "totals")
    before = Window.partitionBy(_KEY).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        _KEY,
        _BUCKET,
        *[F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(before).alias(f"__c_{n}") for n in maxes],
    )
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(_KEY, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    out = base.join(carry, [_KEY, _BUCKET])
    for n in sums:
        out = out.withColumn(
            n,
            F.coalesce(F.col(f"__c_{n}"), F.lit(0)) + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)),
        )
    for n in maxes:
        out = out.withColumn(n, F.greatest(F.max(f"__v_{n}").over(inside), F.col(f"__c_{n}")))
    helper = [f"__{p}_{n}" for n in [*sums, *maxes] for p in ("v", "c")]
    return out.drop(_KEY, _BUCKET, *helper)


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, out: str = "n", max_rows: int | None = None
) -> DataFrame:
    """1-based position of each row in its key's order (``row_number`` without the one-task key)."""
    return running(df, keys, order, bucket, sums={out: F.lit(1).cast("long")}, max_rows=max_rows)


def gap_sessions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, clock: Column, gap: Column,
    session: str = "session", pos: str | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Number the sessions of each key: a row starts a new one when ``clock`` is ``gap`` or more past the row before.

    ``clock`` is a non-decreasing number along ``order``; ``gap`` may differ per row. With ``pos`` the 1-based position
    in the key is added too. Each bucket is summarised by its first and last clock, its inner breaks and its size;
    only these summaries are chained per key.
    """
    keyed = _keyed(df, keys).withColumn("__clock", clock).withColumn("__gap", gap)
    base = keyed.withColumn(_BUCKET, F.coalesce(bucket, F.lit(_NO_TIME)))
    sizes = base.groupBy(_KEY, _BUCKET).agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    limit = max_rows or MAX_BUCKET_ROWS
    if (sizes["top"] or 0) > limit:
        base = _by_ranges(keyed, keys, order, sizes["all"], limit)
    inside = Window.partitionBy(_KEY, _BUCKET).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("__clock") - F.lag("__clock").over(inside)

    def broken(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__break", F.coalesce((step >= F.col("__gap")).cast("long"), F.lit(0).cast("long")))

    summary = broken(base.select(_KEY, _BUCKET, *[F.col(c) for c in order], "__clock", "__gap")).groupBy(_KEY, _BUCKET).agg(
        F.sum("__break").alias("__breaks"), F.count("*").alias("__rows"), F.max("__clock").alias("__end"),
        F.min(F.struct(*order, "__clock", "__gap")).alias("__head"),
    )
    summary = materialize(summary, "summary")
    chain = Window.partitionBy(_KEY).orderBy(_BUCKET)
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.col("__head.__clock") - F.lag("__end").over(chain)
    carry = (
        summary.withColumn("__opens", F.coalesce((lead >= F.col("__head.__gap")).cast("long"), F.lit(1).cast("long")))
        .withColumn("__c_s", F.coalesce(F.sum(F.col("__breaks") + F.col("__opens")).over(before), F.lit(0)) + F.col("__opens"))
        .withColumn("__c_p", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .select(_KEY, _BUCKET, "__c_s", "__c_p")
    )
    out = broken(base).join(carry, [_KEY, _BUCKET]).withColumn(session, F.col("__c_s") + F.sum("__break").over(upto))
    if pos is not None:
        out = out.withColumn(pos, F.col("__c_p") + F.row_number().over(inside))
    return out.drop(_KEY, _BUCKET, "__clock", "__gap", "__break", "__c_s", "__c_p")


def with_halo(df: DataFrame, pos: str, size: int, halo: int) -> DataFrame:
    """Copy rows so that each block of ``size`` positions also holds the ``halo`` rows before it.

    Adds ``block`` and ``home`` (false for the copied halo rows). Windows over (key, block) that look back at
    most ``halo`` rows are then exact on the ``home`` rows, and no task holds more than ``size + halo`` rows.
    """
    if halo > size:
        raise ValueError("halo must not exceed the block size")
    own = F.floor((F.col(pos) - 1) / F.lit(size)).cast("long")
    near_end = F.pmod(F.col(pos) - 1, F.lit(size)) >= size - halo
    blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("block", F.explode(blocks)).withColumn("home", F.col("block") == own)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    value: str,
    out: str,
) -> DataFrame:
    """``value`` of the preceding row of the same key, for a ``value`` that grows along ``order``."""
    return running(df, keys, order, bucket, maxes={out: F.col(value)}, inclusive=False)


#: Bins of one step of a percentile's descent, and steps.
PERCENTILE_BINS, PERCENTILE_STEPS = 4096, 2


def rank_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact nearest-rank percentiles: the value at index ``round_half_even(p * (n - 1))``.

    Each step counts the values between two bounds in equal bins and goes on between the smallest and the largest
    value of the bin that holds the wanted rank; rows outside are dropped before they are counted. What is left after
    the steps, a part in millions of a smooth distribution, is ordered after collapsing equal values. Returns keys,
    ``p``, ``n`` and ``pctl``.
    """
    base = df.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias(_KEY), F.col(value).cast("double").alias("__x"))
    whole = base.groupBy(_KEY).agg(F.count("*").alias("n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    wanted = whole.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumn("__need", F.bround(F.col("p") * (F.col("n") - 1)).cast("long") + 1)
    between = (F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi"))
    for _ in range(PERCENTILE_STEPS):
        share = F.try_divide(F.col("__x") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
        place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * PERCENTILE_BINS), F.lit(PERCENTILE_BINS - 1)).cast("int")
        rows = base.join(wanted, _KEY).filter(between).withColumn("__bin", place)
        bins = rows.groupBy(_KEY, "p", "n", "__need", "__bin").agg(F.count("*").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        upto = Window.partitionBy(_KEY, "p").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("__cum", F.sum("__c").over(upto)).withColumn("__need", F.col("__need") - (F.col("__cum") - F.col("__c")))
        wanted = bins.filter((F.col("__need") >= 1) & (F.col("__need") <= F.col("__c"))).select(_KEY, "p", "n", "__need", "__lo", "__hi")
    counts = base.join(wanted, _KEY).filter(between).groupBy(_KEY, "p", "n", "__need", "__x").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(_KEY, "p").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    picked = counts.withColumn("__cum", F.sum("__c").over(w)).filter(F.col("__cum") >= F.col("__need")).groupBy(_KEY, "p", "n").agg(F.min("__x").alias("pctl"))
    return picked.select(*[F.col(f"{_KEY}.{k}").alias(k) for k in keys], "p", "n", "pctl")
