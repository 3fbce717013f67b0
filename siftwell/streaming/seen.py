"""Ids that an index may hold, as a table of bits that does not grow with the index.

Each id sets a few bits of a table of fixed size (a Bloom filter), kept as rows of 64 bits in versions: every batch writes the next
one before its rows reach the index, so the table never lacks an id of the index, and a try that failed leaves only bits that are
set in vain. An id that finds a bit unset is new without any look at the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import delete_folder, read_if_any

WORDS = "word long, mask long, version long"


@dataclass(frozen=True)
class Seen:
    """``bits`` (a power of two) of about 32 for each id that the index is meant to hold; with more ids, more known-looking ones are looked up in vain."""

    path: str
    bits: int = 1 << 26
    hashes: int = 6

    def marks(self, ids: DataFrame) -> DataFrame:
        """``tenant, id, word, mask``: the bits of each id."""
        places = F.array(*[F.xxhash64(F.lit(i), "tenant", "id").bitwiseAND(F.lit(self.bits - 1)) for i in range(self.hashes)])
        at = ids.select("tenant", "id", F.explode(places).alias("at"))
        one = F.expr("shiftleft(1L, cast(at & 63 as int))")
        return at.select("tenant", "id", F.shiftright("at", 6).alias("word"), one.alias("mask"))

    def versions(self, spark: SparkSession) -> list[int]:
        """At most three: the newest, the one before it, and one that a failed try has left."""
        rows = read_if_any(spark, self.path, WORDS).select("version").distinct().collect()
        return sorted(r["version"] for r in rows)

    def table(self, spark: SparkSession) -> DataFrame:
        known = self.versions(spark)
        rows = read_if_any(spark, self.path, WORDS)
        return rows.filter(F.col("version") == (known[-1] if known else -1)).select("word", "mask")

    def maybe_known(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` (tenant, id: distinct) all of whose bits are set."""
        table = self.table(ids.sparkSession).withColumnRenamed("mask", "held")
        found = self.marks(ids).join(table, "word").filter(F.col("held").bitwiseAND(F.col("mask")) != 0)
        return found.groupBy("tenant", "id").agg(F.count("*").alias("n")).filter(F.col("n") == self.hashes).select("tenant", "id")

    def add(self, ids: DataFrame) -> None:
        """Write the next version with the bits of ``ids``; versions before the last one go."""
        spark, known = ids.sparkSession, self.versions(ids.sparkSession)
        fresh = self.marks(ids).select("word", "mask")
        both = fresh.unionByName(self.table(spark)).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        both.write.mode("overwrite").parquet(f"{self.path}/version={known[-1] + 1 if known else 0}")
        for version in known[:-1]:
            delete_folder(f"{self.path}/version={version}")
