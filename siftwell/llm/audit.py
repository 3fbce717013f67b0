"""Audit of how filters interact, over every order in which they could run.

Each document gets a mask of the filters that it fails; only counts per part and mask leave the documents. In the
lexicographic order of the permutations all that begin with the same letters form an interval, whose start follows from
the letters' Lehmer code. A mask is removed at step s by the orders that begin with s - 1 filters it passes and one it
fails, so its counts are added at the starts of those intervals and subtracted behind their ends; running sums over
the 120 ranks give what each order removes at each step.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import WORD, cut
from siftwell.session import local_table

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
COUNTS = ["n", "good", "toxic"]


def lehmer_rank(prefix: tuple[int, ...], size: int = len(FILTERS)) -> int:
    """The lexicographic rank of the first permutation of 0..size-1 that begins with these numbers."""
    left, rank = list(range(size)), 0
    for i, x in enumerate(prefix):
        rank += left.index(x) * factorial(size - 1 - i)
        left.remove(x)
    return rank


def removals(size: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, sign): where the count of each mask enters and leaves the running sum of each step."""
    out = []
    for mask in range(1, 1 << size):
        passed = [f for f in range(size) if not mask >> f & 1]
        failed = [f for f in range(size) if mask >> f & 1]
        for step in range(1, len(passed) + 2):
            for before in permutations(passed, step - 1):
                for f in failed:
                    start = lehmer_rank((*before, f), size)
                    out += [(mask, step, start, 1), (mask, step, start + factorial(size - step), -1)]
    return out


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text_key, mask`` without the filter on copies (its bit is added by ``masks``)."""
    t = F.coalesce(docs["text"], F.lit(""))
    df = docs.select("doc_id", F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), t.alias("t"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    rules = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length("t"), F.col("t").rlike(r"[#$%&*|]")]
    mask: Column = sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))
    return df.select("doc_id", "part", F.unhex(F.md5("t")).alias("text_key"), F.length("t").alias("length"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per ``part`` and ``mask``: ``n``, ``good`` and ``toxic`` documents."""
    rows = cut(failures(docs))
    # Of texts that occur more than once, the smallest id; the planner broadcasts these or splits a hot text's rows.
    firsts = rows.groupBy("text_key", "length").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    df = rows.join(cut(firsts.drop("last")), ["text_key", "length"], "left")
    df = df.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0))
    known = labels.groupBy(labels["doc_id"].alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    df = df.join(cut(known.filter("good + toxic > 0")), "doc_id", "left")
    return df.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count(F.when(F.col("good") == 1, 1)).alias("good"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order of the five filters and step (1-5).

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. Filters, on whole
    texts (null: empty): A under 50 words; B under 65 % distinct words; C over 5 % capitals; D any of ``#$%&*|``; E the
    text of a row with a smaller doc_id. Rows without an id never fail E and have no label; rows with one id are documents
    of their own, share their labels and don't make each other fail E. Of several labels of one id any 1 counts. A null source
    and an empty one are one part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = cut(masks(docs, labels))
    ends = local_table(spark, removals(), "mask int, step int, rank int, sign int")
    steps = local_table(spark, [(r, "".join(FILTERS[f] for f in p), s + 1, p[s]) for r, p in enumerate(permutations(range(len(FILTERS)))) for s in range(len(FILTERS))], "rank int, filter_order string, step int, filter int")
    added = counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS])

    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << f) > 0, F.col("n")).otherwise(0)) for f in range(len(FILTERS))]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(len(FILTERS))]).alias("alone"),
    )
    cells = totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))).join(F.broadcast(steps), "rank")  # 600 rows for each part
    cells = cells.join(added, ["part", "step", "rank"], "left")
    ranks = Window.partitionBy("part", "step").orderBy("rank")  # 120 rows
    df = cells.select("part", "filter_order", "step", "rank", "filter", "total", F.get("fails", F.col("filter")).alias("fails"), F.get("alone", F.col("filter")).alias("unique_fails"), *[F.sum(F.coalesce(c, F.lit(0))).over(ranks).alias(c) for c in COUNTS])
    along = Window.partitionBy("part", "rank").orderBy("step")  # five rows
    df = df.withColumn("kept", F.col("total") - F.sum("n").over(along)).withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "filter")))  # 600 / 5 rows
    return df.select("part", "filter_order", "step", "kept", F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
