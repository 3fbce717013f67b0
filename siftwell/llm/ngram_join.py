"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is their hash, with the most frequent ones last. It is cut into fragments, at least
``Join.fragments`` of them; each fragment of a document goes its own way, tasks count what pairs share within
one fragment, and the counts are summed per pair and held against the threshold (``setjoin``). The pairs to count are those whose
prefixes allow a link: two linked documents share one of the first n-grams of each, and with a prefix that is longer by k they share k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import hashing
from siftwell.llm.bits import Bits
from siftwell.llm.setjoin import Block, Frequent, Items, Join, SetJoin, item_hash


class Documents(Items):
    """A text's distinct shingles of ``width`` words, A-Z lower-cased; of all its words if they are fewer."""

    shared_percent = 5

    def __init__(self, width: int, percent: int) -> None:
        self.width, self.percent = width, percent

    def read(self, docs: np.ndarray, texts: pa.Array, wanted: Bits | None = None) -> Iterator[Block]:
        if wanted is not None:
            keep = wanted.has(item_hash(docs, np.zeros(len(docs), np.int64)))
            docs, texts = docs[keep], texts.filter(pa.array(keep))
        data, offsets = hashing.text_bytes(texts)
        hashes, rows, _ = hashing.words(data, offsets)
        if not len(docs):
            return
        tokens, sizes = hashing.shingle_sets(hashes, rows, self.width)
        block = Block(docs, np.zeros(len(docs), np.int64), tokens, np.concatenate([[0], np.cumsum(sizes)]))
        yield block.only(sizes > 0) if (sizes == 0).any() else block

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """A linked document misses at most (100 - percent) % of the tokens; so many more are shared."""
        return np.minimum(sizes, sizes - -(-self.percent * sizes // 100) + np.maximum(1, sizes * self.shared_percent // 100))

    def leading(self, block: Block, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of each item: indexes of tokens, and items."""
        item = np.repeat(np.arange(len(lengths)), lengths)
        return block.offsets[item] + np.arange(len(item)) - np.repeat(np.cumsum(lengths) - lengths, lengths), item

    def zone(self, block: Block) -> np.ndarray:
        sizes = block.sizes()
        index, _ = self.leading(block, np.minimum(sizes, self.prefix(sizes) + sizes // 20))
        return block.tokens[index]

    def keys(self, block: Block, late: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = block.sizes()
        lengths = self.prefix(sizes)
        index, item = self.leading(block, lengths)
        keys = block.tokens[index]
        last = late.has(block.tokens)
        hits = np.concatenate([[0], np.cumsum(last)])
        held = hits[block.offsets[1:]] - hits[block.offsets[:-1]]
        starts = np.cumsum(lengths) - lengths
        for i in np.unique(item[last[index]]).tolist():
            a, b = block.offsets[i], block.offsets[i + 1]
            tokens, rest = block.tokens[a:b], last[a:b]
            keys[starts[i] : starts[i] + lengths[i]] = np.concatenate([tokens[~rest], tokens[rest]])[: lengths[i]]
        return keys, item, held

    def tail(self, sizes: np.ndarray, late: np.ndarray) -> np.ndarray:
        return np.maximum(0, sizes - late - self.prefix(sizes))


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80, plan: Join | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents whose shingle sets have a Jaccard similarity of ``percent`` hundredths link; ``component_id`` is the smallest
    doc_id that links reach. Documents without words, or null, have no shingles and no links. A row without an id links
    with nothing and has no component. Rows with one id are one document in the result's names, each with its own set.
    """
    join = SetJoin(docs, Documents(width, percent), plan or Join(percent))
    members, classes = join.classes()
    named = members.join(classes, "node", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("first_doc", "doc_id").alias("component_id"))
    return named.unionByName(without_sets(docs, width))


def without_sets(docs: DataFrame, width: int) -> DataFrame:
    """The rows that hold no item: no id, no text or no word. Sets of rows without an id are counted apart."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    bare = rows.filter(F.col("doc_id").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    items = Documents(width, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.zeros(len(ids), np.int64)
            for block in items.read(np.arange(len(ids)), texts):
                sizes[block.docs] = block.sizes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), ids], names=["doc_id", "n_shingles", "component_id"])

    return bare.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller id; rows with no set and one id's repetitions stay."""
    found = similar_documents(docs, width, percent)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
