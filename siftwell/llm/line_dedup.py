"""Fuzzy line dedup: of lines that are near copies of each other, one stays in the corpus.

Lines become sets of character shingles. MinHash signatures in bands with a high recall give runs of lines that share a
band. Short runs give all their pairs, long ones a star around the member that agrees most with the others; pairs whose
short sketches of the signatures agree too little to be linked go at once. Exact Jaccard similarities verify the rest, and
distributed union-find joins them. Members of a long run that are still in different components are then compared
with its other members in blocks, so that a run costs no row per pair. Of each component the first line stays.
Lines too short for two shingles join with equal ones only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import hashing
from siftwell.llm.bits import bits_of, fitting
from siftwell.llm.common import cut, forget
from siftwell.llm.components import components
from siftwell.llm.setjoin import Block, Items, posted, slices
from siftwell.llm.vectors import forest

POSTING = np.dtype([("key", "<u8"), ("node", "<i8"), ("sketch", "<u4")])
#: Signature values whose last two bits make up a sketch.
SKETCHED = 16
PAIR, MEMBER = 0, 1


@dataclass(frozen=True)
class Lines:
    """At a similarity of 0.8, 12 bands of 4 miss 0.2 % of the pairs; lines shorter than ``min_chars`` are left alone, empty ones always."""

    width: int = 7
    percent: int = 80
    bands: int = 12
    rows: int = 4
    min_chars: int = 20
    #: Runs up to this length give all their pairs.
    short_run: int = 16
    #: Values of two sketches that agree. Unequal values agree in one case of four, so sketches of lines at 0.8 agree in
    #: 13.6 of 16 on average, and in fewer than 7 in one pair of 100,000.
    agree: int = 7
    #: Members of a block in the comparison of what is left of long runs, on either side.
    block: int = 2048


#: Every line that holds more than white space.
EVERY = Lines(min_chars=1)


def multipliers(n: int) -> np.ndarray:
    """Odd 32-bit numbers, the same everywhere."""
    return (hashing.mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def lines_of(texts: pa.Array, min_chars: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All lines (split at \\n), lower-cased with white space collapsed, the rows they stand in, and their numbers."""
    lines: list[str] = []
    owners: list[int] = []
    numbers: list[int] = []
    least = max(min_chars, 1)
    for row, text in enumerate(texts.to_pylist()):
        if text:
            for i, raw in enumerate(text.lower().split("\n")):
                line = " ".join(raw.split())
                if len(line) >= least:
                    lines.append(line)
                    owners.append(row)
                    numbers.append(i)
    return lines, np.array(owners, np.int64), np.array(numbers, np.int32)


def nodes_of(lines: list[str]) -> np.ndarray:
    """A hash of each line; equal lines are one node."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64).view(np.int64)


def pieces(lines: list[str], chars: int = 1 << 18) -> Iterator[slice]:
    """Stretches of about so many characters (a longer line is a stretch of its own)."""
    at = 0
    while at < len(lines):
        to, held = at, 0
        while to < len(lines) and (to == at or held + len(lines[to]) <= chars):
            held += len(lines[to])
            to += 1
        yield slice(at, to)
        at = to


class LineItems(Items):
    """Lines as 32-bit hashes of their shingles."""

    dtype = np.dtype("<u4")

    def __init__(self, plan: Lines) -> None:
        self.plan = plan

    def grams(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingle hashes of the joined lines, where each line's begin among them, and how many it has; those in between cross lines."""
        width = self.plan.width
        short = [i for i, x in enumerate(lines) if len(x) <= width]
        # Padded, short lines have two grams, which give way to the halves of the line's 64-bit hash.
        padded = list(lines)
        for i in short:
            padded[i] = lines[i].ljust(width + 1)
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.fromiter(map(len, padded), np.int64, len(padded))
        hashes, starts = hashing.grams(points, width), np.cumsum(chars) - chars
        for i in short:
            hashes[starts[i] : starts[i] + 2] = np.frombuffer(hashlib.blake2b(lines[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint32)
        return hashes, starts, chars - width + 1

    def block(self, owner: np.ndarray, number: np.ndarray, lines: list[str]) -> Block:
        hashes, starts, counts = self.grams(lines)
        line = np.repeat(np.arange(len(lines)), counts)
        tokens = hashes[np.arange(len(line)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)]
        both = np.sort((line.astype(np.uint64) << np.uint64(32)) | tokens)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        sizes = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(lines))
        return Block(owner, number, both.astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)]))

    def signatures(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Band keys (one row per line) and sketches."""
        plan = self.plan
        tokens, starts, counts = self.grams(lines)
        ends = np.stack([starts, starts + counts], axis=1).ravel()[:-1]  # the last line ends with the array
        factors = multipliers(2 * plan.bands * plan.rows)
        keys, sketch, hashed = np.empty((len(lines), plan.bands), np.uint64), np.zeros(len(lines), np.uint32), np.empty_like(tokens)
        for band in range(plan.bands):
            with np.errstate(over="ignore"):
                key = np.full(len(lines), np.uint64(band + 1) * hashing.BASE)
                for row in range(plan.rows):
                    k = 2 * (band * plan.rows + row)
                    np.bitwise_xor(tokens, factors[k + 1], out=hashed)
                    np.multiply(hashed, factors[k], out=hashed)
                    least = np.minimum.reduceat(hashed, ends)[::2]
                    key = hashing.mixed(key * hashing.BASE + least)
                    if k < 2 * SKETCHED:
                        # The least values lie low; their last bits are spread before two are taken.
                        sketch |= ((least * np.uint32(0x9E3779B1)) >> np.uint32(30)) << np.uint32(k)
            keys[:, band] = key
        return keys, sketch


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values two sketches agree."""
    x = a ^ b
    return SKETCHED - np.bitwise_count((x | (x >> np.uint32(1))) & np.uint32(0x55555555))


def runs_of(records: np.ndarray, plan: Lines) -> pd.DataFrame:
    """``kind, a, b``: pairs of lines that share a band (b the centre of a long run), and members (b: the run's key) of long runs."""
    # Most keys occur once: only the others' records are sorted by node, too.
    order = np.argsort(records["key"])
    keys = records["key"][order]
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    again[:-1] |= again[1:]
    records = records[order[again]]
    records = records[np.lexsort((records["node"], records["key"]))]
    fresh = np.ones(len(records), bool)
    fresh[1:] = (records["key"][1:] != records["key"][:-1]) | (records["node"][1:] != records["node"][:-1])
    records = records[fresh]
    starts = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]])) if len(records) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(records)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, plan.short_run + 1):
        first = starts[lengths == n]
        i, j = np.triu_indices(n, 1)
        left.append((first[:, None] + i).ravel())
        right.append((first[:, None] + j).ravel())
    members = [np.zeros(0, np.int64)]
    for at, n in zip(starts[lengths > plan.short_run].tolist(), lengths[lengths > plan.short_run].tolist(), strict=True):
        sketches = records["sketch"][at : at + n]
        common = np.uint32(0)  # the most frequent value at each place
        for place in range(0, 2 * SKETCHED, 2):
            values = (sketches >> np.uint32(place)) & np.uint32(3)
            common |= np.uint32(np.bincount(values, minlength=4).argmax() << place)
        centre = int(agreement(sketches, common).argmax())
        others = np.delete(np.arange(at, at + n), centre)
        left.append(others)
        right.append(np.full(n - 1, at + centre))
        members.append(np.arange(at, at + n))
    x, y = np.concatenate(left), np.concatenate(right)
    near = agreement(records["sketch"][x], records["sketch"][y]) >= plan.agree
    x, y, m = x[near], y[near], np.concatenate(members)
    pairs = pd.DataFrame({"kind": PAIR, "a": records["node"][x], "b": records["node"][y]}).drop_duplicates()
    return pd.concat([pairs, pd.DataFrame({"kind": MEMBER, "a": records["node"][m], "b": records["key"][m].view(np.int64)})]).astype({"kind": "int32", "a": "int64", "b": "int64"})


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common numbers of two sorted lists."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def linked_pairs(batch: pa.RecordBatch, items: LineItems) -> pa.RecordBatch:
    """The pairs (a, b, line_a, line_b) whose sets reach the threshold."""
    percent, keep = items.plan.percent, []
    a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    for at in pieces([x + y for x, y in zip(a, b, strict=True)], 1 << 22):
        texts = list(dict.fromkeys(a[at] + b[at]))
        sets = {}
        for part in pieces(texts):
            block = items.block(np.zeros(0), np.zeros(0), texts[part])
            sets.update(zip(texts[part], np.split(block.tokens, block.offsets[1:-1]), strict=True))
        for x, y in zip(a[at], b[at], strict=True):
            x, y = sets[x], sets[y]
            both = overlap(x, y) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
            keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def links_across(strays: pd.DataFrame, members: pd.DataFrame, items: LineItems) -> list[tuple[int, int]]:
    """Links between strays and members of other components, as many as connect what they connect."""
    plan = items.plan
    texts = members["text"].tolist()
    blocks = [items.block(np.zeros(0), np.zeros(0), texts[part]) for part in pieces(texts)]
    tokens = np.concatenate([b.tokens for b in blocks])
    sizes = np.concatenate([b.sizes() for b in blocks])
    starts = np.cumsum(sizes) - sizes
    vocabulary, codes = np.unique(tokens, return_inverse=True)
    nodes, component = members["node"].to_numpy(np.int64), members["component"].to_numpy(np.int64)
    marked = np.zeros(len(vocabulary), bool)
    found_a: list[int] = []
    found_b: list[int] = []
    rows = strays[["node", "component", "text"]].itertuples(index=False)
    for node, own, text in rows:
        mine = items.block(np.zeros(0), np.zeros(0), [text]).tokens
        at = np.searchsorted(vocabulary, mine)
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == mine)]
        marked[at] = True
        both = np.add.reduceat(marked[codes], starts, dtype=np.int64)
        marked[at] = False
        hit = nodes[(100 * both >= plan.percent * (sizes + len(mine) - both)) & (component != own)]
        found_a += [node] * len(hit)
        found_b += hit.tolist()
    return forest(np.array(found_a, np.int64), np.array(found_b, np.int64))


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, text`` of the rows with both; equal texts of one id have equal keys."""
    df = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"].alias("text"))
    return df.filter("doc_id is not null and text is not null")


def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Row numbers and texts (the last column) of a batch, in slices of bounded size."""
    numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(batch.num_columns - 1)], names=["i", "text"])
    return slices(numbered)


class LineJoin:
    """Classes of similar lines among the rows of ``docs``."""

    def __init__(self, docs: DataFrame, plan: Lines) -> None:
        self.docs, self.plan, self.items = identified(docs), plan, LineItems(plan)
        #: Parts follow the splits of the input, whose size is bounded.
        self.parts = 4 * max(1, self.docs.rdd.getNumPartitions())

    def members(self) -> DataFrame:
        """``doc_id, text_key, line, node`` of every line."""
        plan = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, texts in batches_of(batch):
                    lines, rows, numbers = lines_of(texts, plan.min_chars)
                    owner = pa.array(at[rows])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(numbers), pa.array(nodes_of(lines))], names=["doc_id", "text_key", "line", "node"])

        return cut(self.docs.mapInArrow(run, "doc_id long, text_key long, line int, node long"))

    def runs(self) -> DataFrame:
        plan, items, parts = self.plan, self.items, self.parts

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in batches_of(batch):
                    lines = [x for x in dict.fromkeys(lines_of(texts, plan.min_chars)[0]) if len(x) > plan.width]
                    if lines:
                        nodes, found = nodes_of(lines), [items.signatures(lines[part]) for part in pieces(lines)]
                        keys = np.concatenate([k for k, _ in found])
                        records = np.empty(keys.size, POSTING)
                        records["key"], records["node"] = keys.ravel(), np.repeat(nodes, plan.bands)
                        records["sketch"] = np.repeat(np.concatenate([s for _, s in found]), plan.bands)
                        yield posted(records, parts, records["key"])

        def find(frame: pd.DataFrame) -> pd.DataFrame:
            return runs_of(np.frombuffer(b"".join(frame["blob"]), POSTING), plan)

        blobs = self.docs.select("text").mapInArrow(post, "part long, blob binary")
        return cut(blobs.groupBy("part").applyInPandas(find, "kind int, a long, b long"))

    def texts(self, asked: DataFrame) -> DataFrame:
        """``node, text``: the asked nodes' lines."""
        plan, size = self.plan, fitting(asked.count())
        shared = self.docs.sparkSession.sparkContext.broadcast(bits_of(asked, "node", size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in batches_of(batch):
                    lines = [x for x in dict.fromkeys(lines_of(texts, plan.min_chars)[0]) if len(x) > plan.width]
                    nodes = nodes_of(lines)
                    keep = np.flatnonzero(shared.value.has(nodes.view(np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array([lines[i] for i in keep], pa.string())], names=["node", "text"])

        found = self.docs.select("text").mapInArrow(run, "node long, text string").join(asked, "node", "left_semi")
        return cut(found.groupBy("node").agg(F.first("text").alias("text")))

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        items = self.items
        a, b = [texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return cut(both.mapInArrow(lambda batches: (linked_pairs(x, items) for x in batches if len(x)), "a long, b long"))

    def across(self, members: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
        """Links within long runs (``node, key``) between components: all members outside a run's largest component are compared with the others."""
        items, size = self.items, self.plan.block
        rows = cut(members.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")))
        counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
        runs = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")).filter("main.n < n")
        runs = cut(runs.select("key", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / size).cast("int").alias("across"), F.ceil(F.col("n") / size).cast("int").alias("down")))
        divided = cut(rows.join(runs, "key").join(texts, "node"))
        stray = divided.filter("component <> main").withColumn("x", F.pmod(F.xxhash64("node"), "across").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
        other = divided.withColumn("y", F.pmod(F.xxhash64("node"), "down").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
        names = ["key", "x", "y", "node", "component", "text"]

        def compare(strays: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            edges = links_across(strays, others, items) if len(strays) and len(others) else []
            return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

        tiles = stray.select(names).groupBy("key", "x", "y").cogroup(other.select(names).groupBy("key", "x", "y"))
        found = cut(tiles.applyInPandas(compare, "a long, b long"))
        forget(rows, runs, divided)
        return found

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """All lines, and of each node whose class has more than one line: ``node, first_doc, first_key, first_line``."""
        members = self.members()
        runs = self.runs()
        pairs = runs.filter(F.col("kind") == PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut(pairs)
        long = cut(runs.filter(F.col("kind") == MEMBER).select(F.col("a").alias("node"), F.col("b").alias("key")))
        forget(runs)
        asked = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(long.select("node")).distinct())
        texts = self.texts(asked)
        links = self.verified(pairs, texts)
        forget(pairs, asked)
        groups = components(links)
        more = self.across(long, groups, texts)
        if not more.isEmpty():
            groups = components(links.unionByName(more))
        forget(texts, long)

        firsts = members.groupBy("node").agg(F.min(F.struct("doc_id", "text_key", "line")).alias("f"), F.count("*").alias("n"))
        joined = groups.select(F.col("id").alias("node"), "component").unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
        touched = firsts.join(cut(joined), "node", "left").filter("n > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
        touched = cut(touched)
        best = touched.groupBy("component").agg(F.min("f").alias("f"))
        return members, cut(touched.select("node", "component").join(cut(best), "component").select("node", F.col("f.doc_id").alias("first_doc"), F.col("f.text_key").alias("first_key"), F.col("f.line").alias("first_line")))


def repeated_lines(docs: DataFrame, plan: Lines = EVERY) -> DataFrame:
    """``doc_id, text_key, removed``: the numbers (from 0, in order) of the lines of a row that repeat a line elsewhere.

    Of a component of similar lines the one that comes first by doc_id, key (a hash of the text) and number stays. Empty lines, lines
    shorter than ``min_chars``, rows without an id and null or empty texts are left alone. Rows with one id and
    different texts are rows of their own; equal rows of one id have one entry here, and all but one of them lose every
    line (``without_lines``, ``line_report``). A row's lines are listed in one row, as they stand in one text.
    """
    members, classes = LineJoin(docs, plan).classes()
    found = members.join(classes, "node").filter("doc_id <> first_doc or text_key <> first_key or line <> first_line")
    return found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with those lines cut out of ``text`` (and ``n_chars`` counted anew if there is one); null texts stay null.

    Of equal rows (id and text) with any word one stays, the others have lost all their lines and go.
    """
    names = docs.columns
    key = F.xxhash64("text")
    twice = docs.filter("doc_id is not null and text is not null").groupBy(F.col("doc_id").cast("long").alias("__id"), key.alias("__key")).count().filter("count > 1").drop("count")
    twice = cut(twice)
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("__doc"), docs["doc_id"].cast("long").alias("__id"), F.xxhash64(docs["text"]).alias("__key"), docs["text"].alias("__text"))
    if not twice.isEmpty():
        worded = F.coalesce(F.col("__text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        again = rows.filter(worded).join(twice, ["__id", "__key"], "left_semi")
        one = again.groupBy("__id", "__key").agg(F.first("__doc").alias("__doc"), F.first("__text").alias("__text")).select("__doc", "__id", "__key", "__text")
        rows = rows.filter(~worded).unionByName(rows.filter(worded).join(twice, ["__id", "__key"], "left_anti")).unionByName(one)
    lists = removed.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("removed").alias("__removed"))
    df = rows.join(lists, ["__id", "__key"], "left")
    left = F.array_join(F.filter(F.split("__text", "\n"), lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    df = df.withColumn("__text", F.when(F.col("__removed").isNull(), F.col("__text")).otherwise(left))
    values = {c: F.col("__doc")[c] for c in names} | {"text": F.col("__text")}
    if "n_chars" in names:
        values["n_chars"] = F.when(F.col("__removed").isNull(), F.col("__doc")["n_chars"]).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType)
    return df.select(*[values[c].alias(c) for c in names], "__removed")


def dedup_lines(docs: DataFrame, plan: Lines = EVERY) -> DataFrame:
    """The documents without repeated lines; one that loses lines and has no word left is dropped."""
    df = without_lines(docs, repeated_lines(docs, plan))
    return df.filter(F.col("__removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def line_report(docs: DataFrame, plan: Lines = EVERY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_removed, removed`` (line numbers, comma-joined, '' for none).

    Of equal rows of one id the first reports what it loses, the others all their lines.
    """
    members, classes = LineJoin(docs, plan).classes()
    found = members.join(classes, "node").filter("doc_id <> first_doc or text_key <> first_key or line <> first_line")
    removed = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("rid"), size.alias("n_lines")))
    first = rows.filter("doc_id is not null").groupBy("doc_id", "text_key").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = cut(first.drop("n"))
    whole = cut(members.join(first, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("every")))
    df = rows.join(removed, ["doc_id", "text_key"], "left")
    if not first.isEmpty():
        df = df.join(first.join(whole, ["doc_id", "text_key"]), ["doc_id", "text_key"], "left")
        df = df.withColumn("removed", F.when(F.col("rid") > F.col("first"), F.col("every")).otherwise(F.col("removed")))
    listed = F.coalesce(F.concat_ws(",", F.col("removed").cast("array<string>")), F.lit(""))
    return df.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), listed.alias("removed"))
