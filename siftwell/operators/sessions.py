"""Per-user conversation memory and query trails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.operators import ordered as od

# Session gap in seconds, turns and queries read.
GAP_SECONDS, READ_TURNS = 3600, 5
TRAIL_READ = 50
BUCKET_SECONDS = 86400


def sessions(turns: DataFrame, gap: int = GAP_SECONDS, keys: tuple[str, ...] = ("tenant", "user_id"), order: str = "turn") -> DataFrame:
    """Add ``session`` (numbered per key; a pause of ``gap`` seconds starts a new one)."""
    clock = F.unix_micros("ts")
    return od.gap_sessions(turns, keys, ["ts", order], od.time_bucket("ts", BUCKET_SECONDS), clock, F.lit(gap * 1_000_000).cast("long"))


def episode_context(
    turns: DataFrame, gap: int = GAP_SECONDS, read: int = READ_TURNS, keys: tuple[str, ...] = ("tenant", "user_id"),
    order: str = "turn", block: int = 10_000,
) -> DataFrame:
    """Add ``history``: the up to ``read`` earlier turns of the same session, newest first."""
    placed = od.position(turns, list(keys), ["ts", order], od.time_bucket("ts", BUCKET_SECONDS), "__pos")
    # A block holds the rows before its own that a history may reach, so pauses can be told inside the block.
    halo = od.with_halo(placed, "__pos", block, read)
    w = Window.partitionBy(*keys, "block").orderBy("__pos")
    pause = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= gap * 1_000_000
    run = F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = halo.withColumn("__fresh", F.coalesce(pause, F.lit(False)).cast("int")).withColumn("__run", run)
    recent = F.collect_list(F.struct("__run", "q", "a")).over(w.rowsBetween(-read, -1))
    marked = marked.withColumn("__recent", recent).filter("home")
    same = F.filter("__recent", lambda e: e["__run"] == F.col("__run"))
    history = F.transform(F.reverse(same), lambda e: F.struct(e["q"].alias("q"), e["a"].alias("a")))
    return marked.withColumn("history", history).drop("block", "home", "__pos", "__fresh", "__run", "__recent")


def query_trail(log: DataFrame, limit: int = TRAIL_READ, order: str = "request_id") -> DataFrame:
    """Newest ``limit`` queries per tenant with their intent."""
    latest = od.keep_latest(log, limit, [F.col("ts").desc(), F.col(order).desc()], ["tenant"])
    return latest.withColumn("intent", tx.classify_intent(F.col("query")))
