"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a number of words in proportion to its weight, at most ``cap`` times what it holds; what a full
source leaves is shared among the others by weight. A source's weight schedule over training time is integrated,
and the words that stand before a document in its source's draw order are turned, through the inverted integral,
into the document's position. Copies sorted by position, whatever their source, form the training order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import cut, n_words, order_key, running

Schedule = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Curriculum:
    """Weights repeat over the sources in code point order, null last. The schedule beside a weight gives its knots
    (time from 0 to 1, relative weight), joined by straight lines; only the schedule's shape counts."""

    weights: tuple[int, ...] = (5, 2, 1)
    schedules: tuple[Schedule, ...] = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
    cap: int = 3


def source_targets(sized: DataFrame, plan: Curriculum) -> DataFrame:
    """Per source: ``source_size``, ``target`` and ``kind`` (its place among the weights).

    Sources fill up in the order of room per weight. With the first k full, the rest stands at the level
    (total - room of those k) / (weights left); the true level is the highest of these. The windows hold one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    kind = (F.row_number().over(by_name) - 1) % len(plan.weights)
    df = sums.withColumn("kind", kind).withColumn("weight", F.element_at(F.array(*map(F.lit, plan.weights)), F.col("kind") + 1).cast("long"))
    room = F.col("source_size") * plan.cap
    fills = Window.orderBy(room / F.col("weight"), F.col("source").isNull(), "source")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    everything = fills.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(room).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    df = df.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return df.select("source", "source_size", F.least(room.cast("double"), F.col("level") * F.col("weight")).alias("target"), "kind")


def when_drawn(share: Column, schedule: Schedule) -> Column:
    """The time at which a source with this schedule has given out ``share`` of its words: the inverted integral."""
    done = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        done.append(done[-1] + (w0 + w1) / 2 * (t1 - t0))
    given, out = share * F.lit(done[-1]), None
    for i, ((t0, w0), (t1, w1)) in enumerate(zip(schedule, schedule[1:], strict=False)):
        slope, part = (w1 - w0) / (t1 - t0), given - F.lit(done[i])
        if slope:
            time = F.lit(t0) + (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * part)) - F.lit(w0)) / F.lit(slope)
        else:
            time = F.lit(t0) + part / F.lit(w0)
        last = i == len(schedule) - 2
        out = (F.when(given < F.lit(done[i + 1]), time) if out is None else out.when(given < F.lit(done[i + 1]), time)) if not last else (time if out is None else out.otherwise(time))
    return out


def mix(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, copies, positions, places``.

    ``taken`` counts the words that the mix takes, repeats included: whole rounds through the source in its draw
    order, the last one ending inside the document that reaches the target. ``copies`` is the same in whole
    documents, rounded; ``positions`` has one training time in [0, 1) per started copy, in order, and ``places`` the
    words of the whole mix, sources merged, that stand before that copy. Documents without words take nothing and
    have neither. Rows with equal ids follow each other in the order of their size.
    """
    sized = cut(docs.select("doc_id", "source", n_words(docs["text"]).alias("size"), F.monotonically_increasing_id().alias("__row")))
    rows = sized.count()
    drawn = cut(draw(sized, cut(source_targets(sized, plan)), rows, plan))
    merged = cut(merge(drawn, rows))
    found = merged.groupBy("__row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("copy", "position", "place"))).alias("__copies"))
    df = drawn.drop("taken", "positions").join(found, "__row", "left")
    positions = F.coalesce("__copies.position", F.array().cast("array<double>"))
    places = F.coalesce("__copies.place", F.array().cast("array<long>"))
    taken = F.coalesce("taken", F.lit(0).cast("long"))
    return df.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", positions.alias("positions"), places.alias("places"))


def merge(drawn: DataFrame, rows: int) -> DataFrame:
    """The started copies of all sources in one training order: a copy's ``words``, and as ``place`` those of the copies before it.

    The schedules spread positions over [0, 1), so that their leading bits cut the order into stretches of alike size.
    Equal positions, such as the sources' first ones, follow each other by id, source and copy.
    """
    df = drawn.select("__row", "doc_id", "source", "size", "taken", F.posexplode("positions").alias("copy", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    order = F.least(F.floor(F.col("position") * F.lit(float(1 << 60))), F.lit((1 << 60) - 1))
    df = df.select("__row", "doc_id", "source", "copy", "position", words.alias("words"), order.alias("__order"))
    return running(df, [], "__order", ["position", "doc_id", "source", "copy", "__row"], F.col("words"), "place", rows).drop("__order", "doc_id", "source")


def draw(sized: DataFrame, targets: DataFrame, rows: int, plan: Curriculum) -> DataFrame:
    keyed = sized.withColumn("__name", F.coalesce("source", F.lit(""))).withColumn("__none", F.col("source").isNull()).withColumn("__order", order_key(F.col("doc_id")))
    df = running(keyed, ["__name", "__none"], "__order", ["doc_id", "size"], F.col("size"), "__before", rows)
    # One row per source; the planner broadcasts it if it is small, else splits a hot source.
    facts = targets.select(F.coalesce("source", F.lit("")).alias("__name"), F.col("source").isNull().alias("__none"), "source_size", "target", "kind")
    df = df.join(facts, ["__name", "__none"])
    goal = F.floor("target").cast("long")
    starts = [F.col("__before") + e * F.col("source_size") for e in range(plan.cap)]
    parts = [F.least(F.greatest(goal - s, F.lit(0)), F.col("size")) for s in starts]
    taken = sum(parts[1:], parts[0])

    def time(start: Column) -> Column:
        share = F.try_divide(start.cast("double"), goal)
        out = F.when(F.col("kind") == 0, when_drawn(share, plan.schedules[0]))
        for k, schedule in enumerate(plan.schedules[1:], 1):
            out = out.when(F.col("kind") == k, when_drawn(share, schedule))
        return out

    positions = F.array_compact(F.array(*[F.when(p > 0, time(s)) for s, p in zip(starts, parts, strict=True)]))
    copies = F.when(F.col("size") > 0, F.floor(F.try_divide(taken.cast("double"), F.col("size")) + 0.5)).otherwise(0)
    return df.select(*sized.columns, "source_size", "target", taken.cast("long").alias("taken"), copies.cast("long").alias("copies"), positions.alias("positions"))


def training_order(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (``copies``), range-sorted by training position.

    Positions are those of the copies; a copy that only rounding adds stands at the end. Documents without words are
    left out, for the mix takes nothing from them. Equal ids must mean equal rows' sizes or are told apart by them.
    """
    names = docs.columns
    sized = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs["doc_id"], docs["source"], n_words(docs["text"]).alias("size"))
    narrow = cut(sized.drop("doc"))
    plan_rows = draw(narrow, cut(source_targets(narrow, plan)), narrow.count(), plan)
    picks = plan_rows.filter("copies > 0").groupBy("doc_id", "size", "source").agg(F.max("copies").alias("copies"), F.first("positions").alias("positions"))
    picks = picks.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__source"), "copies", "positions")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("size") == F.col("__size")) & F.col("source").eqNullSafe(F.col("__source"))
    drawn = sized.join(picks, same).select("doc", "doc_id", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"), "positions")
    drawn = drawn.withColumn("position", F.when(F.col("copy") < F.size("positions"), F.get("positions", F.col("copy"))).otherwise(F.lit(1.0)))
    return drawn.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("doc.*")
