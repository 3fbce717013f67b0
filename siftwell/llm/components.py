"""Connected components by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, forget


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every id that has a smaller one in its component; the component is its smallest id.

    Every id hooks on to its smallest smaller neighbour, paths are halved until all point at a root, and the edges that
    are left over are rewritten between roots; this repeats until none is left. Each step is an aggregation with
    map-side combine or a join on one id at a time that splits a frequent id; nothing is gathered anywhere.
    """
    left = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct())
    labels = None
    while not left.isEmpty():
        parents = cut(left.groupBy("hi").agg(F.min("lo").alias("root")))
        # Edges that the hooking has not used up.
        rest = left.join(parents, "hi").filter("lo <> root").select("lo", F.col("root").alias("other"))
        rest = cut(rest)
        roots = halved(parents)
        before, labels = labels, roots if labels is None else cut(relabelled(labels, "root", roots).unionByName(roots))
        moved = relabelled(relabelled(rest, "lo", roots), "other", roots)
        used, left = left, cut(moved.select(F.greatest("lo", "other").alias("hi"), F.least("lo", "other").alias("lo")).filter("hi <> lo").distinct())
        forget(used, rest, *([before, roots] if before is not None else []))
    if labels is None:
        return left.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return labels.select(F.col("hi").alias("id"), F.col("root").alias("component"))


def relabelled(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``df`` with the ids in a column replaced by their roots."""
    to = roots.select(F.col("hi").alias("__id"), F.col("root").alias("__root"))
    return df.join(to, df[column] == F.col("__id"), "left").withColumn(column, F.coalesce("__root", column)).drop("__id", "__root")


def halved(parents: DataFrame) -> DataFrame:
    """Pointers followed until each points at a root."""
    while True:
        up = parents.select(F.col("hi").alias("__id"), F.col("root").alias("__up"))
        step = parents.join(up, parents["root"] == F.col("__id"), "left").select("hi", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("moved"))
        step = cut(step)
        if step.filter("moved").isEmpty():
            forget(step)
            return parents
        forget(parents)
        parents = step.drop("moved")
