"""Event-time windows, sessions and pairing over event streams.

Rows later than the watermark are dropped from windows; they stay in the raw table the stream was read from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

DELAY = "10 minutes"


def read_table_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; time columns without zone become instants."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(folder)
    for f in schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            stream = stream.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return stream


def _window_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.unix_timestamp("window.start")).withColumn("window_end", F.unix_timestamp("window.end")).drop("window")


def stream_rate(events: DataFrame, by: list[str], window: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Event counts per tumbling window and label."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window), *by).agg(F.count("*").alias("n"))
    return _window_columns(counted)


def stream_health(events: DataFrame, bad: Column, by: list[str], window: str = "5 minutes", slide: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Errors and requests per sliding window and label, and the requests of its last ``slide`` beside them.

    Two stateful sums in a chain: events are counted once per ``slide``, and the windows add those counts up, so an event costs one
    update of state however many windows overlap.
    """
    steps = events.withWatermark("ts", delay).groupBy(F.window("ts", slide).alias("step"), *by).agg(F.count_if(bad).alias("errors"), F.count("*").alias("n"))
    steps = steps.withColumn("step_end", F.col("step.end"))
    counted = steps.groupBy(F.window(F.window_time("step"), window, slide), *by).agg(
        F.sum("errors").alias("errors"), F.sum("n").alias("n"), F.max_by(F.struct("step_end", "n"), "step_end").alias("last")
    )
    recent = F.when(F.col("last.step_end") == F.col("window.end"), F.col("last.n")).otherwise(0)
    return _window_columns(counted.withColumn("n_recent", recent).drop("last"))


def stream_sessions(events: DataFrame, by: list[str], gap: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Event counts per session; a session ends after ``gap`` without events."""
    counted = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("window"), *by).agg(F.count("*").alias("n"))
    return _window_columns(counted)


def stream_durations(starts: DataFrame, ends: DataFrame, longest: str, delay: str = DELAY) -> DataFrame:
    """Request durations from a start stream and an end stream (request_id, ts); ends may follow up to ``longest`` later.

    A start whose end has not come by then is given out without a duration once the watermark has passed, so requests that never
    end are seen.
    """
    a = starts.select(F.col("request_id").alias("__rid"), F.col("ts").alias("start_ts")).withWatermark("start_ts", delay)
    b = ends.select("request_id", F.col("ts").alias("end_ts")).withWatermark("end_ts", delay)
    joined = a.join(
        b, (F.col("__rid") == F.col("request_id")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {longest}")),
        "leftOuter",
    )
    ms = F.floor((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000).cast("long")
    return joined.select(F.col("__rid").alias("request_id"), ms.alias("duration_ms"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write everything available now to a Parquet table."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
        .trigger(availableNow=True).start()
    )
