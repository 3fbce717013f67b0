"""Classes of items whose token sets are similar, for items and tokens of any kind.

Items (documents, lines) are read from the texts again in each pass, so that only keys and, for items with a candidate
partner, sets are ever shuffled. A pass posts keys of each item; items that share a key form a run. Linked items share
a least number of keys. Short runs count the keys that each of their pairs shares; summed over all runs, and with the
keys that both have in long runs, the count tells which pairs may link. Long runs give a star around a member drawn per
run, among the members with enough keys in long runs. Candidates are verified exactly: the sets that hang together are
cut into fragments of the token order, each fragment counts its own overlaps, and the counts are summed per pair.
Verified pairs give components; then members of one long run that are still apart are compared as well, so no linked
pair can stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import hashing
from siftwell.llm.bits import Bits, bits_of, fitting
from siftwell.llm.common import cut, forget, small_batches
from siftwell.llm.components import components

POSTING = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<i4"), ("late", "<i4")])
RUNS = "kind int, key long, a long, b long, size_a int, size_b int, late int, tail int, n int"
PAIR, MEMBER = 0, 1
#: Words of an item's sketch.
SKETCH = 16
#: What is known of a member of a long run.
FACTS = ["size_a", "late_a", "other_a", "tail_a", *[f"s{w}_a" for w in range(SKETCH)]]


@dataclass
class Block:
    """Items of some rows: whose they are, their tokens (sorted, distinct) one item after the other, and offsets."""

    docs: np.ndarray
    lines: np.ndarray
    tokens: np.ndarray
    offsets: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def nodes(self) -> np.ndarray:
        """A hash of each item's set; equal sets are one node."""
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(hashing.mixed(self.tokens.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
            total = sums[self.offsets[1:]] - sums[self.offsets[:-1]] + self.sizes().astype(np.uint64)
        return hashing.mixed(total).view(np.int64)

    def sketches(self) -> list[np.ndarray]:
        """Each item's tokens as bits of ``SKETCH`` 64-bit words. Sets differ in at least as many tokens as sketches in bits."""
        bits = (hashing.mixed(self.tokens.astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * SKETCH)).astype(np.int64)
        table = np.zeros((len(self.docs), 64 * SKETCH), bool)
        table[np.repeat(np.arange(len(self.docs)), self.sizes()), bits] = True
        return list(np.packbits(table, axis=1).view(np.int64).T.copy())

    def only(self, keep: np.ndarray) -> Block:
        sizes = self.sizes()
        return Block(self.docs[keep], self.lines[keep], self.tokens[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))


def item_hash(docs: np.ndarray, lines: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return hashing.mixed(docs.astype(np.int64).view(np.uint64) * hashing.BASE + lines.astype(np.int64).view(np.uint64))


class Frequent:
    """A sorted list of tokens, with a table of their leading bits that tells most others apart at once."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.tokens = tokens
        self.leading = np.zeros(1 << 20, bool)
        self.leading[(tokens >> np.uint64(44)).astype(np.int64)] = True

    def has(self, tokens: np.ndarray) -> np.ndarray:
        out = self.leading[(tokens >> np.uint64(44)).astype(np.int64)] if len(self.tokens) else np.zeros(len(tokens), bool)
        maybe = np.flatnonzero(out)
        if len(maybe):
            out[maybe] = among(tokens[maybe], self.tokens)
        return out


class Items:
    """How texts become items and items keys. ``wanted`` names items whose tokens are asked for, by ``item_hash``; others may be left out."""

    dtype = np.dtype("<u8")
    #: Linked items share at least this percentage of the smaller one's size in keys, and one key.
    shared_percent = 0

    def read(self, docs: np.ndarray, texts: pa.Array, wanted: Bits | None = None) -> Iterator[Block]:
        raise NotImplementedError

    def keys(self, block: Block, late: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, the items they belong to, and per item the number of its late tokens; its size if keys are no tokens."""
        raise NotImplementedError

    def tail(self, sizes: np.ndarray, late: np.ndarray) -> np.ndarray:
        """How many tokens of items with so many tokens, and late ones, are neither late nor among the keys."""
        return np.zeros(len(sizes), np.int64)

    def zone(self, block: Block) -> np.ndarray | None:
        """Keys whose frequency decides which tokens stand late in the order; none if there is no order."""
        return None


@dataclass(frozen=True)
class Join:
    #: Items link when 100 * intersection >= percent * union.
    percent: int
    #: Runs up to this length give all their pairs.
    short_run: int = 16
    #: Tokens in more items than this are frequent; the most frequent of them, at most so many, stand last in the order.
    frequent: int = 32
    most_late: int = 1 << 18
    #: Of classes of equal sets with so many members only the first posts keys; the largest classes, at most so many, are listed.
    copies: int = 16
    most_copied: int = 1 << 16
    #: Fragments of the token order, at least; sets that hang together and hold more tokens than a piece are cut into more.
    fragments: int = 4
    #: Tokens of one piece of verification, and pairs.
    piece_tokens: int = 1 << 21
    piece_pairs: int = 1 << 17
    #: Items of a salted run on average.
    salted: int = 200_000


def slices(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Ids and texts of a batch in pieces of bounded bytes (a longer text is a piece of its own)."""
    texts, ids = batch.column(1), np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
    _, offsets = hashing.text_bytes(texts)
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield ids[at:to], texts.slice(at, to - at)
        at = to


def posted(postings: np.ndarray, parts: int, parted_by: np.ndarray) -> pa.RecordBatch:
    """Records as one blob per part."""
    part = (parted_by % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, postings = part[order], postings[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(part))
    blobs = [postings[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])


_known: list[Frequent] = []


def frequent(tokens: np.ndarray) -> Frequent:
    """The list with its table, made once per worker and list."""
    if not _known or _known[0].tokens is not tokens:
        _known[:] = [Frequent(tokens)]
    return _known[0]


def among(keys: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which keys are listed (sorted)."""
    return listed[np.minimum(np.searchsorted(listed, keys), len(listed) - 1)] == keys if len(listed) else np.zeros(len(keys), bool)


def runs_of(records: np.ndarray, percent: int, short_run: int, late: np.ndarray) -> pd.DataFrame:
    """Pairs of short runs with the number of keys they share, and members of long ones (rows of RUNS).

    Runs of late keys count as long whatever their length, as they may go on in other parts. ``n`` of a member is 1 if
    its key isn't late.
    """
    records = records[np.lexsort((records["node"], records["key"]))]
    fresh = np.ones(len(records), bool)
    fresh[1:] = (records["key"][1:] != records["key"][:-1]) | (records["node"][1:] != records["node"][:-1])
    records = records[fresh]
    starts = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]])) if len(records) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(records)))
    of_late = among(records["key"][starts], late)
    long = (lengths > short_run) | of_late
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, short_run + 1):
        first = starts[(lengths == n) & ~long]
        if len(first):
            i, j = np.triu_indices(n, 1)
            left.append((first[:, None] + i).ravel())
            right.append((first[:, None] + j).ravel())
    x, y = records[np.concatenate(left)], records[np.concatenate(right)]  # nodes ascend within a run
    near = 100 * np.minimum(x["size"], y["size"]).astype(np.int64) >= percent * np.maximum(x["size"], y["size"]).astype(np.int64)
    pairs = pd.DataFrame({"a": x["node"][near], "b": y["node"][near], "size_a": x["size"][near], "size_b": y["size"][near]})
    pairs = pairs.groupby(["a", "b", "size_a", "size_b"], sort=False).size().rename("n").reset_index().assign(kind=PAIR, key=0, late=0, tail=0)
    m = records[np.repeat(long, lengths)]
    members = pd.DataFrame({"kind": MEMBER, "key": m["key"].view(np.int64) if len(m) else [], "a": m["node"], "b": 0, "size_a": m["size"], "size_b": 0, "late": m["late"], "tail": 0, "n": 1 - np.repeat(of_late & long, lengths)[np.repeat(long, lengths)]})
    names = [c.split()[0] for c in RUNS.split(", ")]
    return pd.concat([pairs, members])[names].astype({n: "int64" if n in ("key", "a", "b") else "int32" for n in names})


def may_link(percent: int) -> Column:
    """Whether the sizes of a pair that shares no key of a short run allow a link, and what it can share at all.

    It shares late tokens, at most as many as either has (``late``), keys of both in long runs that aren't late
    (``other``), and tokens behind the keys of one of them. Those stand behind the keys of the one whose keys end first in
    the order, so they are at most as many as the longer ``tail``. Its sets differ in at least as many tokens as their
    sketches in bits.
    """
    differ = sum((F.bit_count(F.col(f"s{w}_a").bitwiseXOR(F.col(f"s{w}_b"))) for w in range(SKETCH)), F.lit(0))
    least, greatest = F.least("size_a", "size_b").cast("long"), F.greatest("size_a", "size_b").cast("long")
    shared = F.least("late_a", "late_b").cast("long") + F.least("other_a", "other_b") + F.greatest("tail_a", "tail_b")
    enough = shared * (100 + percent) >= percent * (least + greatest)
    return (100 * least >= percent * greatest) & enough & (differ * (100 + percent) <= (100 - percent) * (least + greatest))


class SetJoin:
    """One join over the ``doc_id`` and ``text`` of ``docs``; rows without an id hold no items."""

    def __init__(self, docs: DataFrame, items: Items, plan: Join) -> None:
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).filter("doc_id is not null and text is not null")
        self.items, self.plan, self.spark = items, plan, docs.sparkSession
        small_batches(self.spark)
        #: Parts follow the splits of the input, whose size is bounded.
        self.parts = 4 * max(1, self.docs.rdd.getNumPartitions())

    def members(self) -> DataFrame:
        """``doc_id, line, node, size`` and sketch (``s0`` …) of every item, kept once."""
        items = self.items
        words = [f"s{w}" for w in range(SKETCH)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for docs, texts in slices(batch):
                    for b in items.read(docs, texts):
                        yield pa.RecordBatch.from_arrays([pa.array(b.docs), pa.array(b.lines.astype(np.int32)), pa.array(b.nodes()), pa.array(b.sizes().astype(np.int32)), *map(pa.array, b.sketches())], names=["doc_id", "line", "node", "size", *words])

        return cut(self.docs.mapInArrow(run, "doc_id long, line int, node long, size int, " + ", ".join(f"{w} long" for w in words)))

    def copied(self, firsts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the largest classes of equal sets, sorted, and the hash of the item that stands for each: a list of bounded length."""
        rows = firsts.filter(F.col("n") >= self.plan.copies).orderBy(F.desc("n"), "node").limit(self.plan.most_copied).select("node", "doc_id", "line").collect()
        nodes = np.array([r["node"] for r in rows], np.int64)
        firsts_of = item_hash(np.array([r["doc_id"] for r in rows], np.int64), np.array([r["line"] for r in rows], np.int64))
        order = np.argsort(nodes)
        return nodes[order], firsts_of[order]

    def passed(self, make, copied) -> DataFrame:  # noqa: ANN001
        """Blobs that ``make`` gives for each block of items, without the further members of the largest classes."""
        items, shared, parts = self.items, self.spark.sparkContext.broadcast(copied), self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, first = shared.value
            for batch in batches:
                for docs, texts in slices(batch):
                    for block in items.read(docs, texts):
                        nodes = block.nodes()
                        if len(known):
                            at = np.minimum(np.searchsorted(known, nodes), len(known) - 1)
                            keep = (known[at] != nodes) | (first[at] == item_hash(block.docs, block.lines))
                            block, nodes = block.only(keep), nodes[keep]
                        _, unique = np.unique(nodes, return_index=True)
                        if len(unique) < len(nodes):
                            keep = np.zeros(len(nodes), bool)
                            keep[unique] = True
                            block, nodes = block.only(keep), nodes[keep]
                        if len(nodes):
                            yield posted(*make(block, nodes, parts))

        return self.docs.mapInArrow(run, "part long, blob binary")

    def late(self, copied) -> np.ndarray:  # noqa: ANN001
        """The most frequent tokens, sorted. First those of all items' zones are counted, then all tokens of the items that
        hold a frequent one, for their keys will stand beyond their zones."""
        items, plan, spark = self.items, self.plan, self.spark
        if type(items).zone is Items.zone:
            return np.zeros(0, np.uint64)

        def count(frame: pd.DataFrame) -> pd.DataFrame:
            keys, n = np.unique(np.frombuffer(b"".join(frame["blob"]), np.uint64), return_counts=True)
            return pd.DataFrame({"key": keys[n > plan.frequent].view(np.int64), "n": n[n > plan.frequent]})

        def listed(make) -> np.ndarray:  # noqa: ANN001
            counted = self.passed(make, copied).groupBy("part").applyInPandas(count, "key long, n long")
            rows = counted.orderBy(F.desc("n"), "key").limit(plan.most_late).select("key").collect()
            return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))

        def zones(block: Block, nodes: np.ndarray, parts: int):  # noqa: ANN202
            zone = items.zone(block)
            return zone, parts, zone

        first = listed(zones)
        if not len(first):
            return first
        shared = spark.sparkContext.broadcast(first)

        def whole(block: Block, nodes: np.ndarray, parts: int):  # noqa: ANN202
            hit = np.concatenate([[0], np.cumsum(among(block.tokens, shared.value))])
            tokens = block.only(hit[block.offsets[1:]] > hit[block.offsets[:-1]]).tokens
            return tokens, parts, tokens

        return listed(whole)

    def runs(self, copied, late: np.ndarray, total: int) -> DataFrame:  # noqa: ANN001
        items, plan, salts = self.items, self.plan, max(1, total // self.plan.salted)
        shared = self.spark.sparkContext.broadcast(late)

        def make(block: Block, nodes: np.ndarray, parts: int):  # noqa: ANN202
            keys, item, left = items.keys(block, frequent(shared.value))
            records = np.zeros(len(keys), POSTING)
            records["key"], records["node"], records["size"], records["late"] = keys, nodes[item], block.sizes()[item], left[item]
            if salts == 1 or not len(shared.value):
                return records, parts, keys
            # Runs of frequent tokens may be of any length: they are dealt over several parts.
            salt = np.where(among(keys, shared.value), hashing.mixed(records["node"].view(np.uint64)) % np.uint64(salts), np.uint64(0))
            with np.errstate(over="ignore"):
                return records, parts, hashing.mixed(keys + salt * hashing.BASE)

        def find(frame: pd.DataFrame) -> pd.DataFrame:
            rows = runs_of(np.frombuffer(b"".join(frame["blob"]), POSTING), plan.percent, plan.short_run, shared.value)
            member = rows["kind"] == MEMBER
            rows.loc[member, "tail"] = items.tail(rows.loc[member, "size_a"].to_numpy(np.int64), rows.loc[member, "late"].to_numpy(np.int64)).astype(np.int32)
            return rows

        return cut(self.passed(make, copied).groupBy("part").applyInPandas(find, RUNS))

    def least_shared(self, size: Column, percent: int = 100) -> Column:
        """Keys that an item shares with any linked one of at least ``percent`` of its size."""
        return F.greatest(F.lit(1), F.floor(size.cast("long") * (self.items.shared_percent * percent) / 10_000))

    def candidates(self, runs: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Distinct pairs that may link, and the members of long runs that can have links through those alone.

        The star of a run stands around the member with the most late tokens, the one that copies were likely made from,
        or with the most long runs if there is no order of tokens.
        """
        rows = runs.filter(F.col("kind") == MEMBER).select("key", "a", "size_a", "late", "tail", "n")
        held = cut(rows.groupBy("a").agg(F.count("*").alias("held"), F.sum("n").alias("other_a"), F.max("size_a").alias("size"), F.max("late").alias("late_a"), F.max("tail").alias("tail_a")))
        enough = held.filter(F.col("held") >= self.least_shared(F.col("size"), self.plan.percent))
        sketches = firsts.select(F.col("node").alias("a"), *[F.col(f"s{w}").alias(f"s{w}_a") for w in range(SKETCH)])
        known = cut(enough.select("a", "late_a", "other_a", "tail_a", "held").join(sketches, "a"))
        members = cut(rows.select("key", "a", "size_a").join(known, "a"))
        most = -F.col("held") if type(self.items).zone is Items.zone else -F.col("late_a")
        rank = F.struct(most.alias("first"), F.xxhash64("a", "key").alias("second"), "a", *FACTS)
        chief = members.groupBy("key").agg(F.min(rank).alias("c")).select("key", F.col("c.a").alias("b"), *[F.col(f"c.{x}").alias(x.replace("_a", "_b")) for x in FACTS])
        stars = ordered(members.join(cut(chief), "key").filter("a <> b").filter(may_link(self.plan.percent)))
        counted = runs.filter(F.col("kind") == PAIR).groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
        held_a, held_b = held.select("a", F.col("held").alias("held_a")), held.select(F.col("a").alias("b"), F.col("held").alias("held_b"))
        counted = counted.join(held_a, "a", "left").join(held_b, "b", "left")
        in_long = F.when(F.col("held_a").isNull() | F.col("held_b").isNull(), F.lit(0)).otherwise(F.least("held_a", "held_b"))
        likely = counted.filter(F.col("n") + in_long >= self.least_shared(F.least("size_a", "size_b")))
        return cut(likely.select("a", "b", "size_a", "size_b").unionByName(stars).distinct()), members

    def apart(self, members: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs of one long run that are in different components: every member outside the run's largest component with all others."""
        rows = members.join(groups.select(F.col("id").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
        rows = cut(rows)
        counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.max("tail_a").alias("tail"))
        main = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts"), F.max("tail").alias("longest_tail"))
        main = cut(main.filter("parts > 1").select("key", F.col("m.component").alias("main"), "longest_tail"))
        divided = rows.join(main, "key")
        # A member must be able to share enough with one of the smallest size and the longest tail that may link with it.
        able = (F.col("late_a").cast("long") + F.col("other_a") + F.col("longest_tail")) * 100 >= self.plan.percent * F.col("size_a").cast("long")
        divided = cut(divided.filter(able))
        strays = divided.filter("component <> main")
        others = divided.select("key", F.col("a").alias("b"), *[F.col(x).alias(x.replace("_a", "_b")) for x in FACTS], F.col("component").alias("component_b"))
        met = strays.join(others, "key").filter("component <> component_b and (component_b = main or a < b)").filter(may_link(self.plan.percent))
        return cut(ordered(met).distinct())

    def verified(self, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the threshold."""
        plan = self.plan
        if pairs.isEmpty():
            return self.spark.createDataFrame([], "a long, b long")
        ends = pairs.select(F.col("a").alias("node"), F.col("size_a").alias("size")).unionByName(pairs.select(F.col("b").alias("node"), F.col("size_b").alias("size"))).distinct()
        groups = components(pairs).select(F.col("id").alias("node"), "component")
        ends = cut(ends.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
        grouped = pairs.join(ends.select(F.col("node").alias("a"), "component"), "a")
        tokens = ends.groupBy("component").agg(F.sum("size").alias("tokens"))
        sizes = grouped.groupBy("component").agg(F.count("*").alias("pairs")).join(tokens, "component")
        fragments = F.greatest(F.lit(plan.fragments), F.ceil(F.col("tokens") / plan.piece_tokens).cast("int")).alias("fragments")
        sizes = cut(sizes.select("component", fragments, F.ceil(F.col("pairs") / plan.piece_pairs).cast("int").alias("salts"), "tokens"))
        total = sizes.agg(F.sum(F.col("tokens") * F.col("salts"))).first()[0]
        bundles = max(self.parts, -(-4 * total // plan.piece_tokens))
        bundle = F.pmod(F.xxhash64("component", "fragment", "salt"), F.lit(bundles)).alias("bundle")

        asked = ends.join(sizes, "component").join(firsts.select("node", "doc_id", "line"), "node").select("node", "doc_id", "line", "component", "fragments", "salts")
        sets = self.fragments(cut(asked))
        sets = sets.select(bundle, "component", "fragment", "salt", "node", "tokens")
        spread = F.explode(F.sequence(F.lit(0), F.col("fragments") - 1)).alias("fragment")
        jobs = grouped.join(sizes, "component").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("salts")).cast("int")).select("component", "salt", "a", "b", spread)
        jobs = jobs.select(bundle, "component", "fragment", "salt", "a", "b")
        dtype = self.items.dtype

        def count(sets: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
            tokens = {key: np.frombuffer(t, dtype) for key, t in zip(zip(sets["component"], sets["fragment"], sets["salt"], sets["node"], strict=True), sets["tokens"], strict=True)}
            none = np.zeros(0, dtype)
            out = []
            for c, f, s, a, b in zip(jobs["component"], jobs["fragment"], jobs["salt"], jobs["a"], jobs["b"], strict=True):
                x, y = tokens.get((c, f, s, a), none), tokens.get((c, f, s, b), none)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                out.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0)
            return pd.DataFrame({"a": jobs["a"], "b": jobs["b"], "overlap": out})

        counted = sets.groupBy("bundle").cogroup(jobs.groupBy("bundle")).applyInPandas(count, "a long, b long, overlap long")
        summed = counted.groupBy("a", "b").agg(F.sum("overlap").alias("overlap")).join(pairs, ["a", "b"])
        size = F.col("size_a").cast("long") + F.col("size_b")
        return cut(summed.filter(F.col("overlap") * (100 + plan.percent) >= plan.percent * size).select("a", "b"))

    def fragments(self, asked: DataFrame) -> DataFrame:
        """The tokens of the asked items by fragment of the token order, as often as the pairs are salted."""
        items = self.items

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(item_hash(b.column(0).to_numpy(), b.column(1).to_numpy()).view(np.int64))], names=["item"])

        marks = bits_of(asked.select("doc_id", "line").mapInArrow(hashed, "item long"), "item", fitting(asked.count()))
        shared = self.spark.sparkContext.broadcast(marks)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            for batch in batches:
                for docs, texts in slices(batch):
                    for b in items.read(docs, texts, wanted):
                        keep = wanted.has(item_hash(b.docs, b.lines))
                        if keep.any():
                            b = b.only(keep)
                            blobs = [b.tokens[i:j].tobytes() for i, j in zip(b.offsets[:-1], b.offsets[1:], strict=True)]
                            yield pa.RecordBatch.from_arrays([pa.array(b.docs), pa.array(b.lines.astype(np.int32)), pa.array(b.nodes()), pa.array(blobs, pa.binary())], names=["doc_id", "line", "node", "tokens"])

        found = self.docs.mapInArrow(read, "doc_id long, line int, node long, tokens binary").join(asked, ["doc_id", "line", "node"])
        dtype = items.dtype

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for node, blob, component, n, salts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    tokens = np.frombuffer(blob, dtype)
                    top = 1 << (8 * dtype.itemsize)
                    at = np.searchsorted(tokens, np.array([-(-top * i // n) for i in range(1, n)], dtype)) if n > 1 else []
                    for fragment, piece in enumerate(np.split(tokens, at)):
                        rows += [(component, fragment, salt, node, piece.tobytes()) for salt in range(salts)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["component", "fragment", "salt", "node", "tokens"])

        return found.select("node", "tokens", "component", "fragments", "salts").mapInArrow(split, "component long, fragment int, salt int, node long, tokens binary")

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """All items (``doc_id, line, node, size``), and of each class with more than one: ``node, doc_id, line`` of its first item."""
        members = self.members()
        words = [f"s{w}" for w in range(SKETCH)]
        firsts = members.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("f"), F.count("*").alias("n"), *[F.max(w).alias(w) for w in words])
        firsts = cut(firsts.select("node", F.col("f.doc_id").alias("doc_id"), F.col("f.line").alias("line"), "n", *words))
        copied = self.copied(firsts)
        runs = self.runs(copied, self.late(copied), members.count())
        pairs, long = self.candidates(runs, firsts)
        forget(runs)
        links = self.verified(pairs, firsts)
        forget(pairs)
        groups = components(links)
        more = self.verified(self.apart(long, groups), firsts)
        forget(long)
        if not more.isEmpty():
            groups = components(links.unionByName(more))
        labelled = firsts.join(groups.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        labelled = cut(labelled)
        best = labelled.groupBy("component").agg(F.min(F.struct("doc_id", "line")).alias("f"), F.sum("n").alias("n")).filter("n > 1")
        return members, cut(labelled.select("node", "component").join(cut(best), "component").select("node", F.col("f.doc_id").alias("first_doc"), F.col("f.line").alias("first_line")))


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with the smaller node first."""
    swap = F.col("a") > F.col("b")
    return pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("size_a", "size_b"), ("size_b", "size_a"))])
