"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

Longer documents are cut into full sequences and a rest. Pieces are dealt evenly to groups of bounded size and packed
group by group, largest first. A bin carries two bitmaps: which duplicate clusters it holds (a cluster at most once)
and which places of each source are taken (a source has as many places as an even spread of its pieces over the bins
needs). A piece goes into the tightest bin that is large enough and compatible: bins stand ordered by the room left,
and the search moves from one successor to the next until a bin has no conflict, else a bin is opened.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import cut, n_words

SCHEMA = "doc_id long, piece int, start_word long, n_words long, bin_id long, place int, offset long"


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    #: Pieces that one group holds on average; the memory of a task follows from it.
    group_pieces: int = 1500


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece; pieces come in packing order, sources and clusters as small numbers (cluster -1: alone)."""
    total = sum(sizes)
    least = max(1, -(-total // capacity))
    pieces: dict[int, int] = {}
    for s in sources:
        pieces[s] = pieces.get(s, 0) + 1
    places = {s: -(-n // least) for s, n in pieces.items()}
    first, at = {}, 0
    for s, n in places.items():
        first[s], at = at, at + n
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r words left
    sources_in: list[int] = []
    clusters_in: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        own = ((1 << places[source]) - 1) << first[source]
        mark = 1 << cluster if cluster >= 0 else 0
        chosen, room = -1, size
        left = rooms >> size
        while left:
            step = (left & -left).bit_length() - 1
            room += step
            left >>= step
            for b in by_room[room]:
                if not clusters_in[b] & mark and sources_in[b] & own != own:
                    chosen = b
                    break
            if chosen >= 0:
                break
            left >>= 1
            room += 1
        if chosen < 0:
            chosen, room = len(sources_in), capacity
            sources_in.append(0)
            clusters_in.append(0)
        else:
            by_room[room].remove(chosen)
            if not by_room[room]:
                rooms &= ~(1 << room)
        free = own & ~sources_in[chosen]
        sources_in[chosen] |= free & -free
        clusters_in[chosen] |= mark
        by_room[room - size].append(chosen)
        rooms |= 1 << (room - size)
        out.append(chosen)
    return out


def numbered(values: pd.Series, alone: bool) -> list[int]:
    """Values as numbers from 0 in order of appearance; with ``alone``, -1 for those that occur once."""
    codes, _ = pd.factorize(values, use_na_sentinel=False)
    if not alone:
        return codes.tolist()
    codes = pd.Series(codes)
    often = codes.map(codes.value_counts()) > 1
    again, _ = pd.factorize(codes.where(often))
    return again.tolist()


def pack_group(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], na_position="last").reset_index(drop=True)
    bins = best_fit(frame["n_words"].tolist(), numbered(frame["source"], False), numbered(frame["cluster"], True), capacity)
    frame["bin_id"] = bins
    by_bin = frame.groupby("bin_id", sort=False)
    frame["place"], frame["offset"] = by_bin.cumcount(), by_bin["n_words"].cumsum() - frame["n_words"]
    frame["bin_id"] += frame["bundle"] * (1 << 24)
    return frame[["doc_id", "piece", "start_word", "n_words", "bin_id", "place", "offset"]]


def placed_in_files(sized: DataFrame) -> DataFrame:
    """``sized`` with ``at``: each row's place in the order of the files (by name) and rows that the documents were read from."""
    files = sized.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = cut(files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    return sized.join(files, "file").withColumn("at", F.col("before") + F.col("row")).drop("file", "row", "before")


def pack(docs: DataFrame, plan: Packing = Packing(), cluster: str | None = None, along_files: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start_word, n_words, bin_id, place`` (in the bin) and ``offset`` (words before it there).

    ``cluster`` names a column of duplicate clusters; by default equal texts form one. Null or empty texts become one
    piece without words; a null source is a source; rows with equal ids, and repeated rows, are packed like any others. Only ids and
    sizes are shuffled, and every group is of bounded size whatever source, cluster or row is frequent. Pieces are dealt to
    groups by hash; with ``along_files`` (documents read from files) groups are stretches of the files' order, so that
    ``bin_id`` ascends with it, such as along a training schedule.
    """
    mark = docs[cluster].cast("string") if cluster else F.md5(F.coalesce(docs["text"], F.lit("")))
    where = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")] if along_files else []
    sized = cut(docs.select("doc_id", "source", F.xxhash64(mark).alias("cluster"), n_words(docs["text"]).alias("size"), *where))
    count = F.greatest(F.ceil(F.col("size") / plan.capacity), F.lit(1))
    sums = sized.agg(F.coalesce(F.sum(count), F.lit(0)).alias("pieces"), F.count("*").alias("rows")).first()
    total = sums["pieces"]
    groups = max(1, -(-total // plan.group_pieces))
    # Numbers of the written table's rows tell equal rows apart.
    sized = placed_in_files(sized) if along_files else sized.withColumn("at", F.monotonically_increasing_id())
    stretch = max(1, sums["rows"] * plan.group_pieces // max(1, total))
    bundle = F.floor(F.col("at") / stretch) if along_files else F.pmod(F.xxhash64("doc_id", "piece", "cluster", "at"), F.lit(groups))
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * plan.capacity
    pieces = pieces.select(
        "doc_id",
        "source",
        "cluster",
        "piece",
        start.alias("start_word"),
        F.least(F.lit(plan.capacity).cast("long"), F.col("size") - start).alias("n_words"),
        bundle.cast("long").alias("bundle"),
    )

    return pieces.groupBy("bundle").applyInPandas(lambda f: pack_group(f, plan.capacity), SCHEMA)
