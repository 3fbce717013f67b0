"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def build_session(app: str = "siftwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, ANSI, AQE).

    Cluster sizing (shuffle partitions, executor memory) is left to spark-submit; AQE coalesces
    the configured upper bound down to what the data needs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a temporary folder; a cluster must name one,
    because executors have to see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="siftwell-ckpt-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables below the checkpoint folder; it goes when the application ends."""
    root = checkpoint_root(spark)
    if root not in _folders:
        _folders[root] = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(delete_folder, _folders[root])
    return _folders[root]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the application's folder and read it back, cutting the lineage."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written and nothing reads any more."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            delete_folder(folder)


def delete_folder(folder: str) -> None:
    """Delete a folder of a shared store, if it is there."""
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def read_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows of ``schema`` where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than cores, spread by ``key`` before CPU-heavy row work; larger scans stay as read.

    Only for plain scans: counting their splits starts no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores, key)


#: Rows of texts that pass between Spark and Python at a time: both sides hold some of these batches, with what is made of them.
TEXTS_AT_A_TIME = 500


def small_batches(spark: SparkSession) -> None:
    """Batches for Python of no more than ``TEXTS_AT_A_TIME`` rows from now on, so that a worker's memory does not follow the size of its split."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_AT_A_TIME:
        spark.conf.set(name, TEXTS_AT_A_TIME)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table whose size the planner knows (rows given as Python tuples to ``createDataFrame`` it does not)."""
    parsed = spark.createDataFrame([], schema).schema
    columns = {f.name: pa.array([r[i] for r in rows], type=to_arrow_type(f.dataType)) for i, f in enumerate(parsed.fields)}
    return spark.createDataFrame(pa.table(columns), parsed)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])
