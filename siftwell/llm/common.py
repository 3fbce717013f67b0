"""Helpers that several operators of this folder share."""

from __future__ import annotations

import atexit
import os
import sys
import uuid

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.session import checkpoint_root

#: Words of the text contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


_folders: dict[str, str] = {}


def ship() -> None:
    """Let the package travel with the functions that use it, so that workers need not find it on their path."""
    for name in [n for n in sys.modules if n == "siftwell" or n.startswith("siftwell.")]:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables in the shared folder; it goes when the application ends."""
    root = checkpoint_root(spark)
    root = root if "://" in root else "file://" + os.path.abspath(root.removeprefix("file:"))
    if root not in _folders:
        _folders[root] = f"{root}/llm-{uuid.uuid4().hex}"
        atexit.register(delete, _folders[root])
    return _folders[root]


def delete(folder: str) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, and the planner knows its size."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of whole texts that pass between Spark and Python at a time.
TEXTS_AT_A_TIME = 2000


def small_batches(spark: SparkSession) -> None:
    """Batches of texts no larger than ``TEXTS_AT_A_TIME`` rows from now on: both sides of the exchange hold some of them at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_AT_A_TIME:
        spark.conf.set(name, TEXTS_AT_A_TIME)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            delete(os.path.dirname(files[0]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, 0 for none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def order_key(*columns: Column) -> Column:
    """60 uniform bits from the columns, the same in every run and engine: the order in which documents are drawn."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def running(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str, rows: int) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same keys that stand earlier.

    ``order`` is an ``order_key``. A key's rows are cut into about sqrt(rows) stretches of the order, so that
    neither a stretch nor the list of a key's stretches grows with a hot key. Keys must not be null.
    """
    stretches = max(1, min(1 << 20, round(rows**0.5)))
    df = df.withColumn("__stretch", F.floor(F.shiftright(order, 40) * F.lit(stretches) / F.lit(1 << 20)).cast("int")).withColumn("__value", value)
    sums = df.groupBy(*keys, "__stretch").agg(F.sum("__value").alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum"))
    within = Window.partitionBy(*keys, "__stretch").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, [*keys, "__stretch"]).withColumn(name, F.col("__ahead") + F.coalesce(F.sum("__value").over(within), F.lit(0)))
    return out.drop("__stretch", "__value", "__ahead")
