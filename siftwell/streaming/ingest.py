"""Streaming ingestion: validate, dedup, embed, write, retry, dead-letter, catalog and metrics."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators import embed as em
from siftwell.operators import ingest as ig
from siftwell.session import delete_folder, materialize, read_if_any
from siftwell.sources.files import MESSAGE
from siftwell.streaming.seen import Seen

# Fixed value: attempts after which a failing message goes to the dead-letter table.
MAX_RETRIES = 5
DEFAULT_TENANT = "__default__"
#: Texts are most of what a batch writes: its stage and the index are packed tighter than Spark's default.
PACKED = "zstd"
STATUSES = ("processed", "retried", "failed", "invalid")


@dataclass(frozen=True)
class Paths:
    """Folders of one ingestion: messages in, index out, and what accompanies it."""

    inbox: str
    index: str
    dead: str
    catalog: str
    metrics: str
    checkpoint: str

    #: Bits of the table of seen ids: about 32 for each id that the index is meant to hold.
    seen_bits: int = 1 << 26

    @property
    def stage(self) -> str:
        return self.index.rstrip("/") + "-stage"

    @property
    def seen(self) -> Seen:
        return Seen(self.index.rstrip("/") + "-seen", self.seen_bits)

    @property
    def totals(self) -> str:
        return self.metrics.rstrip("/") + "-totals"


def read_messages(spark: SparkSession, inbox: str, max_files: int = 100) -> DataFrame:
    """Messages of the inbox as a stream; each micro-batch takes up to ``max_files`` files."""
    return (
        spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
        .option("mode", "PERMISSIVE").json(inbox)
    )


def dedup_stream(stream: DataFrame, key: str = "id", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First occurrence per key, remembering keys only as long as the watermark asks for."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def split_dlq(processed: DataFrame, max_retries: int = MAX_RETRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, retry, dead) by error and attempts; retry and dead rows have their attempts raised."""
    failed = processed.filter(F.col("error").isNotNull()).withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)
    return (
        processed.filter(F.col("error").isNull()),
        failed.filter(F.col("attempts") < max_retries),
        failed.filter(F.col("attempts") >= max_retries),
    )


def outcome(max_retries: int) -> Column:
    """The status that ``split_dlq`` gives a row."""
    again = F.coalesce("attempts", F.lit(0)) + 1 < max_retries
    return F.when(F.col("error").isNull(), "processed").when(again, "retried").otherwise("failed")


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to: made with it, lost with it."""
    path = f"{checkpoint}/run"
    names = read_if_any(spark, path, "run string").collect()  # one row
    if not names:
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.mode("overwrite").parquet(path)
        names = spark.read.parquet(path).collect()
    return names[0]["run"]


def index_ids(spark: SparkSession, index: str) -> DataFrame:
    return read_if_any(spark, index, "tenant string, id string, prefix string, batch string").select("tenant", "id", "prefix", "batch")


def not_yet_known(unique: DataFrame, name: str, paths: Paths) -> DataFrame:
    """The rows whose ids no other batch has brought into the index.

    Only ids that the table of seen ids may know are looked up, in the folders of their prefixes; without any the index isn't read.
    """
    spark = unique.sparkSession
    if not paths.seen.versions(spark):  # an index from before, or none
        paths.seen.add(index_ids(spark, paths.index).select("tenant", "id"))
    asked = materialize(paths.seen.maybe_known(unique.select("tenant", "id")).withColumn("prefix", prefix_of("id")), "asked")
    prefixes = [r["prefix"] for r in asked.select("prefix").distinct().collect()]  # sixteen at most
    if not prefixes:
        return unique
    known = index_ids(spark, paths.index).filter(F.col("prefix").isin(*prefixes) & (F.col("batch") != name)).select("tenant", "id")
    return unique.join(known.join(asked.select("tenant", "id"), ["tenant", "id"], "left_semi"), ["tenant", "id"], "left_anti")


def prefix_of(column: str) -> Column:
    return F.substring(F.md5(column), 1, 1)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return ig.catalog_rows(spark.read.parquet(path).select("tenant", "field", "value").distinct())


def stage_batch(batch: DataFrame, name: str, paths: Paths, embedder: em.Embedder, models: str, max_retries: int) -> tuple[DataFrame, dict]:
    """The batch's rows with their outcome (``status``), written below the batch's name and read back, and what was observed on the way.

    One row per tenant and id: the one with the fewest attempts, then the smallest source, page and so on. Ids that the
    index holds from other batches are left out.
    """
    spark, folder = batch.sparkSession, f"{paths.stage}/{name}"
    rows = batch.withColumn("tenant", F.coalesce(F.nullif("tenant", F.lit("")), F.lit(DEFAULT_TENANT))).withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    # The source is read once; all that follows reads the stage.
    rows.write.mode("overwrite").parquet(f"{folder}/messages", compression=PACKED)
    valid, invalid = ig.validate_ingest(spark.read.parquet(f"{folder}/messages"))
    unique = ig.first_per_key(ig.normalise_rows(valid), ["tenant", "id"], ["attempts", "source", "page"])
    unique = ig.select_embed_model(unique.withColumn("prefix", prefix_of("id")), models)
    unique.write.mode("overwrite").parquet(f"{folder}/unique", compression=PACKED)
    unique = spark.read.parquet(f"{folder}/unique")
    fresh = not_yet_known(unique, name, paths)
    embedded = em.embed_safely(fresh, embedder).withColumn("refused", F.lit(False))
    refused = invalid.withColumnRenamed("reason", "error").withColumn("page", F.col("page").cast("long")).withColumn("refused", F.lit(True))
    # Counted while they are written: the totals cost no pass of their own.
    status, seen = F.when(F.col("refused"), "invalid").otherwise(outcome(max_retries)), Observation()
    totals = [F.count_if(status == s).alias(s) for s in STATUSES] + [F.coalesce(F.sum("embed_seconds"), F.lit(0.0)).alias("embed_seconds"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars")]
    embedded.unionByName(refused, allowMissingColumns=True).observe(seen, *totals).write.mode("overwrite").parquet(f"{folder}/rows", compression=PACKED)
    # Split after they are written: each branch reads its rows from the stage, and every text has been embedded once.
    rows = spark.read.parquet(f"{folder}/rows")
    for read in ("messages", "unique"):
        delete_folder(f"{folder}/{read}")
    parts = [*split_dlq(rows.filter(~F.col("refused")), max_retries), rows.filter("refused")]
    done, retry, dead, refused = (part.drop("refused").withColumn("status", F.lit(s)) for part, s in zip(parts, STATUSES, strict=True))
    return done.unionByName(retry).unionByName(dead).unionByName(refused), seen.get


def commit_index(staged: DataFrame, name: str, path: str) -> None:
    """The processed rows as this batch's part of the index, in place of what an earlier try has written.

    Rows of a folder meet in one task, or in several if they are many, so a batch writes few files whatever the number of its tasks.
    """
    done = staged.filter(F.col("status") == "processed").drop("error", "attempts", "status", "embed_seconds").withColumn("batch", F.lit(name))
    done.hint("rebalance", "tenant", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "prefix", "batch").parquet(path, compression=PACKED)


def write_failures(staged: DataFrame, name: str, paths: Paths) -> None:
    """Dead letters, and messages to try again, each below the batch's name."""
    columns = [f.name for f in MESSAGE.fields]
    messages = staged.withColumn("page", F.col("page").cast("int"))
    dead = messages.filter(F.col("status").isin("failed", "invalid")).select(*columns, F.col("error").alias("reason"))
    dead.write.mode("overwrite").parquet(f"{paths.dead}/batch={name}")
    retry = messages.filter(F.col("status") == "retried").select(*columns)
    if not retry.isEmpty():
        retry.write.mode("ignore").json(f"{paths.inbox}/retry-{name}", compression="gzip")  # kept from an earlier try: it may have been read


def write_metrics(staged: DataFrame, name: str, paths: Paths, insert_seconds: float, handle_seconds: float) -> None:
    """Rows and embedding time per tenant and status, and the batch's times, below the batch's name."""
    counts = staged.groupBy("tenant", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("embed_seconds"), F.lit(0.0)).alias("embed_seconds"))
    timed = counts.withColumn("insert_seconds", F.lit(insert_seconds)).withColumn("handle_seconds", F.lit(handle_seconds))
    timed.coalesce(1).write.mode("overwrite").parquet(f"{paths.metrics}/batch={name}")


def write_totals(observed: dict, spark: SparkSession, name: str, paths: Paths, handle_seconds: float) -> None:
    """The batch's observed totals as one row, below the batch's name."""
    row = {**observed, "handle_seconds": handle_seconds}
    schema = ", ".join(f"{c} long" for c in (*STATUSES, "chars")) + ", embed_seconds double, handle_seconds double"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(row[c] for c in names)], schema).coalesce(1).write.mode("overwrite").parquet(f"{paths.totals}/batch={name}")


def process_batch(batch: DataFrame, batch_id: int, run: str, paths: Paths, embedder: em.Embedder, models: str, max_retries: int = MAX_RETRIES) -> None:
    """One micro-batch. It is staged first; all outputs follow from the staged rows and replace what an earlier try of the
    same batch has written, so it may be repeated after a failure at any point. A run that starts anew, on a new
    checkpoint, writes below names of its own."""
    start, name = time.time(), f"{run}-{batch_id}"
    staged, observed = stage_batch(batch, name, paths, embedder, models, max_retries)
    write_failures(staged, name, paths)
    processed = staged.filter(F.col("status") == "processed")
    if observed["processed"]:
        paths.seen.add(processed.select("tenant", "id"))  # before the index holds them
    ig.catalog_parts(processed).write.mode("overwrite").parquet(f"{paths.catalog}/batch={name}")
    insert = time.time()
    commit_index(staged, name, paths.index)
    write_metrics(staged, name, paths, time.time() - insert, time.time() - start)
    write_totals(observed, batch.sparkSession, name, paths, time.time() - start)
    delete_folder(f"{paths.stage}/{name}")


def ingest_stream(
    spark: SparkSession, paths: Paths, embedder: em.Embedder | None = None, models: str = "default:large", max_files: int = 100,
    max_retries: int = MAX_RETRIES, available_now: bool = True,
) -> StreamingQuery:
    """Run the ingestion over the inbox. Restarting with the same checkpoint resumes at the last unfinished batch."""
    model = embedder or em.HashedCounts()
    run = run_of(spark, paths.checkpoint)
    writer = (
        read_messages(spark, paths.inbox, max_files)
        .writeStream.option("checkpointLocation", paths.checkpoint)
        .foreachBatch(lambda df, batch_id: process_batch(df, batch_id, run, paths, model, models, max_retries))
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def work_done(query: StreamingQuery) -> tuple[int, int]:
    """The newest job of a query and how many tasks its running jobs have finished: it changes as long as the query gets on."""
    tracker = SparkSession.active().sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(query.runId))]
    stages = [tracker.getStageInfo(s) for j in jobs if j and j.status == "RUNNING" for s in j.stageIds]
    return max((j.jobId for j in jobs if j), default=-1), sum(s.numCompletedTasks for s in stages if s)


def run_to_end(query: StreamingQuery, seconds: int = 600) -> None:
    """Wait for an ``availableNow`` query however long it works; one that finishes no task for ``seconds`` is stopped. Re-raises its error."""
    before = work_done(query)
    while not query.awaitTermination(seconds):
        now = work_done(query)
        if now == before:
            query.stop()
            raise TimeoutError(f"stream without progress for {seconds} s")
        before = now


def progress_rows(query: StreamingQuery) -> list[dict]:
    """Per micro-batch: rows read, rate and duration, from the query's progress reports."""
    return [
        {"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond"), "ms": p["durationMs"].get("triggerExecution")}
        for p in query.recentProgress
    ]
