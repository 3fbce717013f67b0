"""Benchmark decontamination by winnowing.

Texts are reduced to fingerprints: of every stretch of k-grams the one with the smallest hash. With stretches of
length - k + 1 k-grams, any shared span of ``length`` words shares a fingerprint. Documents' fingerprints that a table of
bits knows from the benchmark are extended to the windows of ``length`` words around them; these are joined with the
benchmark's own by fingerprint and window. Documents with the same set of windows are one class and are
joined once, so a passage that many documents share costs no row per document in the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import hashing
from siftwell.llm.bits import Bits, bits_of, fitting
from siftwell.llm.common import cut, forget
from siftwell.llm.setjoin import slices

#: Bytes of words: digits, letters and everything beyond ASCII.
ALNUM = hashing.LETTERS.copy()
ALNUM[48:58] = True
#: A window's fingerprint and its own hash; and with its length and where it starts.
KEY = np.dtype([("print", "<i8"), ("key", "<i8")])
HIT = np.dtype([("length", "<i4"), ("start", "<i4"), *KEY.descr])


@dataclass(frozen=True)
class Winnowing:
    #: Words of a window; a shorter benchmark text is one window of its own length.
    length: int = 10
    #: Words of a k-gram.
    gram: int = 5
    #: Bits for each benchmark window in the table, and the least and the most bits; beyond, only more windows pass by mistake.
    bits_each: int = 32
    least_bits: int = 1 << 20
    most_bits: int = 1 << 28


def winnowed(words: np.ndarray, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of each row (offsets ``rows`` into its words), the position of each one's fingerprint, and all k-gram hashes.

    The fingerprint is the last smallest k-gram of the window, so equal windows have equal ones.
    """
    grams = hashing.rolled(words, gram)
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    first, end = rows[:-1], rows[1:] - length + 1
    fits = end > first
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, first[fits], 1)
    np.add.at(steps, end[fits], -1)
    span = length - gram + 1
    least = grams[:n].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : n + j], out=least)
    at, unset = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(span - 1, -1, -1):
        hit = np.flatnonzero(unset & (grams[j : n + j] == least))
        at[hit] = hit + j
        unset[hit] = False
    starts = np.flatnonzero(np.cumsum(steps[:n]) > 0)
    return starts, at[starts], grams


def window_keys(words: np.ndarray, rows: np.ndarray, length: int, gram: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows whose fingerprints ``keep`` knows, their rows, fingerprints and hashes."""
    starts, at, grams = winnowed(words, rows, length, gram)
    if keep is not None and len(at):
        chosen = np.unique(at)
        good = np.zeros(len(grams), bool)
        good[chosen] = keep(grams[chosen] + np.uint64(length))
        starts, at = starts[good[at]], at[good[at]]
    whole = hashing.rolled(words, length)[starts] if len(starts) else np.zeros(0, np.uint64)
    return starts, np.searchsorted(rows, starts, "right") - 1, grams[at] + np.uint64(length), hashing.mixed(whole ^ np.uint64(length))


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = hashing.text_bytes(texts)
    found, rows, _ = hashing.words(data, offsets, ALNUM)
    return found, rows


def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The texts of a batch (its second column) with their numbers in it."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(1)], names=["i", "text"])


def benchmark_windows(items: DataFrame, plan: Winnowing) -> DataFrame:
    """``item, length, print, key``: the windows of each benchmark text, each with its fingerprint and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(numbered(batch)):
                words, rows = word_rows(texts)
                sizes = np.diff(rows)
                for length in np.unique(np.minimum(sizes[sizes > 0], plan.length)).tolist():
                    mine = np.flatnonzero((sizes == length) | ((sizes > length) & (length == plan.length)))
                    picked = np.concatenate([words[rows[i] : rows[i + 1]] for i in mine])
                    _, row, prints, keys = window_keys(picked, np.concatenate([[0], np.cumsum(sizes[mine])]), length, min(plan.gram, length))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[mine[row]])), pa.array(np.full(len(row), length, np.int32)), pa.array(prints.view(np.int64)), pa.array(keys.view(np.int64))], names=["item", "length", "print", "key"])

    rows = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item"), F.coalesce(items["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item string, length int, print long, key long")


def candidates(docs: DataFrame, prints: Bits, windows: Bits, lengths: list[int], plan: Winnowing) -> DataFrame:
    """One row per document: ``doc_id, n_words``, ``hits`` (the windows that the benchmark may hold, see HIT) and ``keys`` (their
    distinct fingerprints and hashes, see KEY, sorted); both null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(numbered(batch)):
                words, rows = word_rows(texts)
                found: dict[int, list[np.ndarray]] = {}
                for length in lengths:
                    starts, row, marks, keys = window_keys(words, rows, length, min(plan.gram, length), prints.has)
                    known = np.flatnonzero(windows.has(keys))
                    hits = np.zeros(len(known), HIT)
                    hits["length"], hits["start"], hits["print"], hits["key"] = length, starts[known] - rows[row[known]], marks[known].view(np.int64), keys[known].view(np.int64)
                    edges = np.flatnonzero(np.concatenate([[True], row[known][1:] != row[known][:-1]])) if len(known) else np.zeros(0, np.int64)
                    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(known)], strict=False):
                        found.setdefault(int(row[known[a]]), []).append(hits[a:b])
                hits = [np.concatenate(found[i]) if i in found else None for i in range(len(texts))]
                keys = [None if h is None else np.unique(h[["print", "key"]].astype(KEY)).tobytes() for h in hits]
                blobs = [None if h is None else h.tobytes() for h in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.diff(rows)), pa.array(blobs, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "n_words", "hits", "keys"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, hits binary, keys binary")


def decontaminate(docs: DataFrame, benchmark: DataFrame, plan: Winnowing = Winnowing()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``spans``.

    A window is ``length`` consecutive words of a benchmark text, or all its words if they are fewer; a word of a document is hit
    inside any occurrence of a window. ``items_sha256`` digests the ids of the texts with such windows, as distinct
    strings in order, comma-joined; ``spans`` lists the hit words as start:end (words from 0, end exclusive), comma-joined. A null text has
    no words, on either side. Texts without an id count as one with the id ''; texts with one id as one. Rows
    with one doc_id, or none, are documents of their own. Without any benchmark text nothing is hit. Words are compared by
    64-bit hashes, windows by another one over those.
    """
    listed = cut(benchmark_windows(benchmark, plan))
    sizes = {r["length"]: r["n"] for r in listed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    size = fitting(sum(sizes.values()), plan.bits_each, plan.least_bits, plan.most_bits)
    windows = listed.select("item", "print", "key").distinct()
    rows = cut(candidates(docs, bits_of(listed, "print", size), bits_of(listed, "key", size), sorted(sizes), plan))

    # One class for each set of windows; its windows are looked up in the benchmark once.
    classes = cut(rows.filter("keys is not null").groupBy(F.sha2("keys", 256).alias("class")).agg(F.first("keys").alias("keys")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                keys = np.frombuffer(blob.as_py(), KEY)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(keys), pa.string()), pa.array(keys["print"]), pa.array(keys["key"])], names=["class", "print", "key"])

    met = cut(classes.mapInArrow(unpack, "class string, print long, key long").join(windows, ["print", "key"]))
    items = met.groupBy("class", "item").agg(F.lit(1)).groupBy("class").agg(F.sort_array(F.collect_list("item")).alias("items"))
    real = met.groupBy("class").agg(F.collect_set("key").alias("real"))
    facts = items.join(real, "class").select("class", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "real")
    found = rows.withColumn("class", F.sha2("keys", 256)).drop("keys").join(cut(facts), "class", "left")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for blob, real in zip(batch.column(2), batch.column(3), strict=True):
                if not real.is_valid:
                    n_hit.append(0)
                    spans.append("")
                    continue
                hits = np.frombuffer(blob.as_py(), HIT)
                hits = hits[np.isin(hits["key"], np.asarray(real.values, np.int64))]
                hits = hits[np.argsort(hits["start"], kind="stable")]
                start, end = hits["start"].astype(np.int64), np.maximum.accumulate(hits["start"].astype(np.int64) + hits["length"])
                first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                a, b = start[first], end[np.append(first[1:], len(end)) - 1]
                n_hit.append(int((b - a).sum()))
                spans.append(",".join(f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), *[batch.column(i) for i in (4, 5)], pa.array(spans, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans"])

    none = F.sha2(F.lit(""), 256)
    ready = found.select("doc_id", "n_words", "hits", "real", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"))
    out = ready.mapInArrow(extend, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, spans string")
    forget(listed, classes)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame, plan: Winnowing = Winnowing()) -> DataFrame:
    """The rows of ``docs`` without contaminated ones; rows with the id of one that is contaminated go too, rows without an id stay."""
    gone = decontaminate(docs, benchmark, plan).filter("contaminated").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
