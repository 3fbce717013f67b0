"""K-d tree sharding: equal shards by bytes, cut along the metadata in which a node's documents spread the most.

A node that stands for k shards is cut where its lower part holds floor(k/2)/k of its bytes, along its widest dimension.
The cuts are weighted quantiles, found by histograms that narrow down step by step: the rows stay where they are, and
the driver sees at most ``BINS`` sums per node and step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, forget, order_key, running, scratch

BINS = 1024
#: Nodes that the driver holds at a time; the subtrees below as many nodes are grown one after the other.
MOST_SHARDS = 4096
COORDINATE_BITS, TIE_BITS = 16, 32
#: A cut may miss its quantile by this share of a shard.
TOLERANCE = 0.002


def leading(column: str) -> Column:
    """The first six bytes of a string as a number that keeps the order."""
    digits = F.substring(F.hex(F.encode(F.coalesce(column, F.lit("")), "UTF-8")), 1, 12)
    return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("double")


def dimensions(size: Column) -> dict[str, Column]:
    """The metadata along which documents are split, as numbers; null ids count as 0."""
    return {"arrival": F.coalesce(F.col("doc_id"), F.lit(0)).cast("double"), "length": F.log2(size.cast("double")), "source": leading("source"), "lang": leading("lang")}


def at_node(values: list[int], kind: str = "long") -> Column:
    """The value that belongs to a row's node."""
    return F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("node") + 1)


def lies_in(flags: list[bool]) -> Column:
    return at_node([int(f) for f in flags], "int") == 1


def own_key(dims: list[int]) -> Column:
    """A row's key along the dimension of its node."""
    return F.element_at("keys", at_node(dims, "int") + 1)


def quantiles(rows: DataFrame, dims: list[int], goals: list[float], slack: list[float], wide: list[bool]) -> list[int]:
    """Per wide node the key below which ``goals`` bytes lie, to within ``slack`` bytes or one key."""
    n = len(dims)
    base, below, shift, found = [0] * n, [0] * n, [COORDINATE_BITS + TIE_BITS - 10] * n, [0] * n
    searched = list(wide)
    while any(searched):
        step = rows.filter(lies_in(searched)).select("node", "size", (own_key(dims) - at_node(base)).alias("past"), at_node(shift, "int").alias("shift"))
        step = step.select("node", "size", F.expr("shiftright(past, shift)").alias("bin")).filter(f"bin >= 0 and bin < {BINS}")
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in step.groupBy("node", "bin").agg(F.sum("size").alias("size")).collect():  # BINS rows per node at most
            sums.setdefault(r["node"], []).append((r["bin"], r["size"]))
        for i in range(n):
            if not searched[i]:
                continue
            reached, chosen = below[i], (0, 0)
            for chosen in sorted(sums.get(i, [])):
                if reached + chosen[1] >= goals[i]:
                    break
                reached += chosen[1]
            lower = base[i] + (chosen[0] << shift[i])
            if chosen[1] <= slack[i] or shift[i] == 0:
                found[i] = lower if goals[i] - reached <= chosen[1] / 2 else lower + (1 << shift[i])
                searched[i] = False
            else:
                base[i], below[i], shift[i] = lower, reached, max(0, shift[i] - 10)
    return found


def grow(rows: DataFrame, dims: int, shards: int, until: int = 1) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``rows`` (keys, size; a written table that goes) with ``node``, and the nodes' first shards and numbers of shards, at most ``until`` each. The rows stay
    in their partitions at every level."""
    nodes = [(0, shards)]
    rows = rows.withColumn("node", F.lit(0))
    while any(k > until for _, k in nodes):
        wide = [k > until for _, k in nodes]
        tops = [F.shiftright(F.col("keys")[d], TIE_BITS) for d in range(dims)]
        spread = [(F.max(t) - F.min(t)).alias(f"spread{d}") for d, t in enumerate(tops)]
        facts = {r["node"]: r for r in rows.filter(lies_in(wide)).groupBy("node").agg(F.sum("size").alias("size"), *spread).collect()}  # a row per node
        widest, goals, slack = [0] * len(nodes), [0.0] * len(nodes), [0.0] * len(nodes)
        for i, (_, k) in enumerate(nodes):
            if r := facts.get(i):
                widest[i] = max(range(dims), key=lambda d: (r[f"spread{d}"], -d))
                goals[i], slack[i] = r["size"] * (k // 2) / k, TOLERANCE * r["size"] / k
        cuts = quantiles(rows, widest, goals, slack, [w and i in facts for i, w in enumerate(wide)])
        low, high, below = [], [], []
        for first, k in nodes:
            low.append(len(below))
            high.append(len(below) + (k > until))
            below += [(first, k // 2), (first + k // 2, k - k // 2)] if k > until else [(first, k)]
        # Kept per level: the rows are narrow, and an expression over all levels would outgrow compiled code.
        above, rows = rows, cut(rows.withColumn("node", F.when(own_key(widest) < at_node(cuts), at_node(low, "int")).otherwise(at_node(high, "int"))))
        nodes = below
        forget(above)
    return rows, nodes


def grown(rows: DataFrame, dims: int, shards: int) -> DataFrame:
    """``rows`` with ``shard``. A tree with more than ``MOST_SHARDS`` leaves is grown down to nodes of several shards; then each of
    those is a tree of its own, which reads and writes its own rows only."""
    until = -(-shards // MOST_SHARDS)
    rows, nodes = grow(rows, dims, shards, until)
    if until == 1:
        return rows.withColumn("shard", at_node([first for first, _ in nodes], "int"))
    spark, folder = rows.sparkSession, f"{scratch(rows.sparkSession)}/trees-{uuid.uuid4().hex}"
    rows.write.partitionBy("node").parquet(f"{folder}/in")
    parts = spark.read.schema(rows.schema).parquet(f"{folder}/in")
    for node in sorted(r["node"] for r in parts.select("node").distinct().collect()):  # MOST_SHARDS at most
        first, k = nodes[node]
        sub, below = grow(cut(parts.filter(F.col("node") == node).drop("node")), dims, k)
        sub.withColumn("shard", at_node([first + f for f, _ in below], "int")).write.mode("append").parquet(f"{folder}/out")
    return spark.read.schema(rows.withColumn("shard", F.lit(0)).schema).parquet(f"{folder}/out") if parts.head(1) else rows.withColumn("shard", F.lit(0))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 16, ``text_crc32`` unsigned, both as for an empty text where it is null.
    The number of shards is given, or follows from the bytes that one shall hold. Ties along a dimension are broken by
    32 bits of the id's hash, so groups of equal rows or metadata are cut too; rows with one id stay together. ``slot``
    counts a shard's documents from 0 in the order of a hash. An empty table gives no rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    size = (F.octet_length(text) + 16).cast("long")
    df = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dims = dimensions(F.col("size"))
    df = df.select("doc_id", "size", "text_crc32", *[c.alias(k) for k, c in dims.items()], F.expr("crc32(cast(coalesce(cast(doc_id as string), 'null') as binary))").alias("tie"))
    df = cut(df)
    facts = df.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(k).alias(f"{n}_{k}") for k in dims for n, f in (("min", F.min), ("max", F.max))]).first()
    shards = shards or max(1, -(-(facts["bytes"] or 0) // (target_bytes or 1 << 30)))
    keys = []
    for d, k in enumerate(dims):
        lo, width = facts[f"min_{k}"] or 0.0, (facts[f"max_{k}"] or 0.0) - (facts[f"min_{k}"] or 0.0)
        coordinate = F.floor((F.col(k) - lo) / (width or 1.0) * ((1 << COORDINATE_BITS) - 1)).cast("long")
        keys.append(F.shiftleft(coordinate, TIE_BITS) + F.col("tie"))
    rows = cut(df.select("doc_id", "size", "text_crc32", F.array(*keys).alias("keys")))
    out = grown(rows, len(dims), shards).withColumn("__order", order_key(F.col("doc_id")))
    out = running(out, ["shard"], "__order", ["doc_id", "size", "text_crc32"], F.lit(1), "slot", facts["rows"])
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
