"""Index tables as partitioned Parquet: append, scan, dual write, backup, versions and their pointer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import materialize, release, side_by_side

POINTER = "active string, canary string, previous string, read_preferred string, build_started timestamp, last_promotion timestamp"


def write_index(df: DataFrame, path: str, partition: str | None = "tenant") -> None:
    """Append rows, one folder per tenant.

    Rows are gathered by tenant first so that tasks do not each write a file per tenant; the rebalance splits a hot
    tenant over several tasks.
    """
    if partition is None:
        df.write.mode("append").parquet(path)
    else:
        df.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def scan_index(spark: SparkSession, path: str, cols: list[str], limit: int | None = None) -> DataFrame:
    """Projected scan; only the named columns are read."""
    out = spark.read.parquet(path).select(*cols)
    return out if limit is None else out.limit(limit)


def dual_write(df: DataFrame, primary: str, secondary: str, log: str, as_of: Column | None = None, batch_id: int = 0) -> str | None:
    """Write to the primary, then to the secondary; a failing secondary is only recorded.

    Each side's write adds a row (role, ts, batch_id, error) to ``log``. Returns the secondary's error, if any.
    """
    # The input is computed once, for the copy that both sides are written from.
    rows = materialize(df, "dual")
    write_index(rows, primary)
    error = None
    try:
        write_index(rows, secondary)
    except Exception as e:  # noqa: BLE001 - the primary write must stand whatever the secondary does
        error = type(e).__name__
    spark = df.sparkSession
    release(rows)
    entries = spark.createDataFrame([("primary", batch_id, None), ("secondary", batch_id, error)], "role string, batch_id long, error string")
    entries.withColumn("ts", as_of if as_of is not None else F.current_timestamp()).coalesce(1).write.mode("append").parquet(log)
    return error


def successful_writes(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.parquet(log).filter(F.col("error").isNull())


def write_lines(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append rows as JSON lines, or a single text column as it is; with ``partition`` one folder per value."""
    writer = df.write.mode("append")
    if partition:
        writer = writer.partitionBy(partition)
    if [t for c, t in df.dtypes if c != partition] == ["string"]:
        writer.text(path)
    else:
        writer.option("ignoreNullFields", "false").json(path)


def backup_index(df: DataFrame, path: str, day: str, fmt: str = "parquet") -> str:
    """Copy a table below ``path`` for a day; a day's backup is replaced as a whole."""
    target = f"{path}/date={day}"
    df.write.mode("overwrite").format(fmt).save(target)
    return target


def table_checksum(df: DataFrame, key: str) -> DataFrame:
    """Row count, distinct keys and an order-free checksum of a table."""
    cols = [F.col(c) for c in sorted(df.columns)]
    return df.select(F.col(key), F.xxhash64(*cols).alias("__h")).agg(
        F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.bit_xor("__h").alias("checksum")
    )


#: Leaves of a digest tree at most, and the children of a node.
MOST_LEAVES, FANOUT = 1 << 20, 64


def _marked(df: DataFrame, columns: list[str], key: str, leaves: int) -> DataFrame:
    """``df`` with the leaf of its key and 128 bits that stand for the row; nulls are told apart from their neighbours."""
    cols = [df[c] for c in columns]
    marks = [F.concat_ws("", *[c.isNull().cast("int").cast("string") for c in cols]), *cols]
    return df.select(*cols, F.pmod(F.xxhash64(key), F.lit(leaves)).alias("__leaf"), F.xxhash64(F.lit(1), *marks).alias("__a"), F.xxhash64(F.lit(2), *marks).alias("__b"))


def digest_tree(df: DataFrame, columns: list[str], key: str, leaves: int) -> DataFrame:
    """``level, node, n, x, y, s``: digests of the ranges of a key's hash, from the leaves (level 0) up to the root.

    A digest holds the rows' number, the exclusive or of both halves of their marks and a sum of them, so it combines in any order and with
    partial sums in the tasks; a node's digest combines those of its children.
    """
    sums = [F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("s").alias("s")]
    rows = _marked(df, columns, key, leaves).select("__leaf", F.lit(1).alias("n"), F.col("__a").alias("x"), F.col("__b").alias("y"), F.shiftright("__a", 24).cast("decimal(38,0)").alias("s"))
    level = materialize(rows.groupBy(F.col("__leaf").alias("node")).agg(*sums), "digests")
    tree, depth, width = level.withColumn("level", F.lit(0)), 0, leaves
    while width > 1:
        depth, width = depth + 1, -(-width // FANOUT)
        level = level.withColumn("node", F.floor(F.col("node") / FANOUT)).groupBy("node").agg(*sums)
        tree = tree.unionByName(level.withColumn("level", F.lit(depth)))
    return tree.select("level", "node", "n", "x", "y", "s")


def damaged_leaves(original: DataFrame, restored: DataFrame, key: str, leaves: int) -> DataFrame:
    """``__leaf`` of the key ranges whose digests differ, found from the root down: below equal nodes nothing is compared."""
    columns = original.columns
    mine, theirs = (materialize(digest_tree(df, columns, key, leaves), "tree") for df in (original, restored))
    depth, width = 0, leaves
    while width > 1:
        depth, width = depth + 1, -(-width // FANOUT)
    open_: DataFrame | None = None
    for level in range(depth, -1, -1):
        a, b = (t.filter(F.col("level") == level).drop("level") for t in (mine, theirs))
        if open_ is not None:
            a, b = (t.join(open_, F.floor(t["node"] / FANOUT) == open_["__up"], "left_semi") for t in (a, b))
        same = a.join(b, ["node", "n", "x", "y", "s"], "left_semi").select("node")
        found = a.select("node").unionByName(b.select("node")).distinct().join(same, "node", "left_anti")
        found = materialize(found.select(F.col("node").alias("__up")), "differing")
        if found.isEmpty():
            open_ = found
            break
        open_ = found
    return open_.withColumnRenamed("__up", "__leaf")


def _leaves_for(df: DataFrame) -> int:
    return max(1, min(MOST_LEAVES, round(df.count() ** 0.5)))


def validate_restore(original: DataFrame, restored: DataFrame, key: str | None = None, leaves: int | None = None) -> DataFrame:
    """One row: rows missing from the restored table and rows it has in excess (as multisets).

    Digests of ranges of the key (the first column by default) are compared first; rows are shuffled, by 128 bits each, for ranges that
    differ only. An equal restore shuffles digests, about the square root of its rows in number.
    """
    key, columns = key or original.columns[0], original.columns
    n = leaves or _leaves_for(original)
    damaged = damaged_leaves(original, restored, key, n)

    def hashed(df: DataFrame, sign: int) -> DataFrame:
        rows = _marked(df, columns, key, n).join(F.broadcast(damaged), "__leaf", "left_semi")  # MOST_LEAVES numbers at most
        return rows.select("__a", "__b", F.lit(sign).alias("__d"))

    diff = hashed(original, 1).unionByName(hashed(restored, -1)).groupBy("__a", "__b").agg(F.sum("__d").alias("__d")).filter("__d <> 0")
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("__d") < 0, -F.col("__d"))), F.lit(0)).alias("excess"),
    )


def repair_restore(original: DataFrame, restored: DataFrame, key: str | None = None, leaves: int | None = None) -> DataFrame:
    """The restored table made equal to the original: rows of key ranges that differ are taken out and inserted again from the original; all others stay."""
    key, columns = key or original.columns[0], original.columns
    n = leaves or _leaves_for(original)
    damaged = F.broadcast(damaged_leaves(original, restored, key, n))
    kept = _marked(restored, columns, key, n).join(damaged, "__leaf", "left_anti")
    again = _marked(original, columns, key, n).join(damaged, "__leaf", "left_semi")
    return kept.select(*columns).unionByName(again.select(*columns))


# ---- versions ----------------------------------------------------------------------------------------


def read_pointer(spark: SparkSession, path: str) -> dict:
    """The current pointer row as a dict (the newest file; the table holds one row per change)."""
    row = spark.read.schema("version long, " + POINTER).parquet(path).orderBy(F.col("version").desc()).first()
    return row.asDict()


def _write_pointer(spark: SparkSession, path: str, state: dict, version: int) -> dict:
    # Appended, never overwritten: a reader always finds a complete row, and old versions are the history.
    row = {**state, "version": version}
    schema = "version long, " + POINTER
    names = [c.split(" ")[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], schema).coalesce(1).write.mode("append").parquet(path)
    return row


def init_pointer(spark: SparkSession, path: str, active: str) -> dict:
    return _write_pointer(spark, path, {"active": active, "read_preferred": "primary"}, 0)


def begin_canary(spark: SparkSession, path: str, canary: str, at) -> dict:
    state = read_pointer(spark, path)
    return _write_pointer(spark, path, {**state, "canary": canary, "build_started": at}, state["version"] + 1)


def promote(spark: SparkSession, path: str, gate_passed: bool | None, at, force: bool = False) -> dict:
    """Switch the active table to the canary if its gate passed (or was never run, or ``force``).

    Returns the decision: promoted, reason, and the pointer. The previous table stays in place.
    """
    state = read_pointer(spark, path)
    if not state.get("canary"):
        return {"promoted": False, "reason": "no_canary", "pointer": state}
    if not force and gate_passed is False:
        return {"promoted": False, "reason": "gate_not_passed", "pointer": state}
    new = {**state, "active": state["canary"], "previous": state["active"], "canary": None, "last_promotion": at}
    done = _write_pointer(spark, path, new, state["version"] + 1)
    return {"promoted": True, "reason": "forced" if force else "gate_passed", "pointer": done}


def failover(spark: SparkSession, path: str, to: str) -> dict:
    """Choose which side reads go to."""
    side = (to or "primary").lower()
    if side not in ("primary", "secondary"):
        raise ValueError("to must be primary or secondary")
    state = read_pointer(spark, path)
    return _write_pointer(spark, path, {**state, "read_preferred": side}, state["version"] + 1)


def read_preferred(spark: SparkSession, pointer: str, primary: str, secondary: str) -> DataFrame:
    """The table reads should use now."""
    side = read_pointer(spark, pointer).get("read_preferred") or "primary"
    return spark.read.parquet(secondary if side == "secondary" else primary)


def lifecycle_status(spark: SparkSession, pointer: str, deny: DataFrame) -> DataFrame:
    """Pointer state beside the denylist size."""
    state = spark.read.schema("version long, " + POINTER).parquet(pointer).orderBy(F.col("version").desc()).limit(1)
    size = deny.agg(F.countDistinct("source").alias("denied"))
    return side_by_side(state, size)
