"""A training corpus from raw documents: quality rules, line dedup, near-copy join, source mix and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. The first four return the columns of their input; the last returns where each piece is packed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import line_dedup, mixing, ngram_join, packing, quality
from siftwell.llm.common import ship, table
from siftwell.session import checkpoint_root, delete_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.accepted(docs)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those of which nothing is left go."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return ngram_join.distinct_documents(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; a document stands in it as often as it is taken."""
    return mixing.training_order(docs)


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece; copies of a document go to different bins, and bins follow the training order of the mix's files."""
    return packing.pack(docs, along_files=bool(docs.inputFiles()))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", fuzzy_lines),
    ("n-gram jaccard join", near_copies),
    ("source mix", source_mix),
    ("best-fit packing", packed_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete_folder(f"{folder}/{i - 1}")  # its reader has written
    return docs


#: The near-copy stages can't be said in SQL that runs on whole tables; tests compare them with brute force.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

ship()
