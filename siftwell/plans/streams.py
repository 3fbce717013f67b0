"""Registered streaming queries: each runs its stream over the given tables to the end and returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import ingest as ig
from siftwell.plans import ingesting as ing
from siftwell.plans import usage as uq
from siftwell.plans import views as vw
from siftwell.plans.registry import query
from siftwell.sources import files as fs
from siftwell.streaming import ingest as si
from siftwell.streaming import reuse as sr
from siftwell.streaming import windows as sw

MSG, LOG = ing._MSG, "WITH " + vw.SQL_LOG


def events(spark, sf_dir):
    schema = vw.table(spark, sf_dir, "events").schema
    return sw.read_table_stream(spark, sf_dir, "events.parquet", schema)


def sink(spark, stream, label):
    out = ing.scratch(spark, label)
    si.run_to_end(sw.to_table(stream, out, out + "-checkpoint"))
    return spark.read.parquet(out)


def ingested(spark, sf_dir):
    """The chunks enqueued twice and ingested; returns the folders."""
    base = ing.scratch(spark, "stream")
    paths = si.Paths(*(f"{base}/{n}" for n in ("inbox", "index", "dead", "catalog", "metrics", "checkpoint")))
    rows = ing.messages(spark, sf_dir).withColumn("id", F.lit(""))
    fields = [f.name for f in fs.MESSAGE.fields if f.name in rows.columns]
    ig.ingest_rows(rows).select(*fields).write.json(paths.inbox, compression="gzip")
    fs.enqueue(ing.messages(spark, sf_dir), paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths, models="default:small"))
    return paths


_IDS = MSG + """, ok AS (SELECT tenant, sha1(text) AS id, text, source, coalesce(doc_type, '') AS doc_type, date, row_number() OVER (PARTITION BY tenant, sha1(text) ORDER BY source, page, coalesce(doc_type, ''), date) AS rn FROM msg WHERE length(text) >= 1)"""


@query("p1_streamed_index", _IDS + " SELECT tenant, id, source, CAST(length(text) AS BIGINT) AS n_chars FROM ok WHERE rn = 1")
def p1(spark, sf_dir):
    """Every distinct valid text of a tenant arrives in the index once, though each was enqueued twice."""
    return spark.read.parquet(ingested(spark, sf_dir).index).select("tenant", "id", "source", F.length("text").cast("long").alias("n_chars"))


@query("p2_resumed_index", _IDS + " SELECT count(DISTINCT (tenant, id)) AS ids, count(DISTINCT (tenant, id)) AS rows FROM ok")
def p2(spark, sf_dir):
    """A second run on the same checkpoint and a run on a lost checkpoint add nothing."""
    paths = ingested(spark, sf_dir)
    si.run_to_end(si.ingest_stream(spark, paths))
    si.run_to_end(si.ingest_stream(spark, si.Paths(paths.inbox, paths.index, paths.dead, paths.catalog, paths.metrics, paths.checkpoint + "2")))
    return spark.read.parquet(paths.index).agg(F.countDistinct("tenant", "id").alias("ids"), F.count("*").alias("rows"))


@query("p3_streamed_dedup", "SELECT event_id, event_type FROM events")
def p3(spark, sf_dir):
    """Two copies of the events in one stream, deduplicated by id."""
    both = events(spark, sf_dir)
    both = both.unionByName(events(spark, sf_dir))
    return sink(spark, si.dedup_stream(both, "event_id", "ts", "60 days"), "dedup").select("event_id", "event_type")


@query("p4_dead_letters", MSG + " SELECT tenant, 'empty_text' AS reason, count(*) AS n FROM msg WHERE length(text) = 0 GROUP BY tenant")
def p4(spark, sf_dir):
    dead = spark.read.parquet(ingested(spark, sf_dir).dead)
    return dead.groupBy("tenant", "reason").agg(F.count("*").alias("n"))


@query("p5_isolated_failures", _IDS + """ SELECT CASE WHEN contains(text, 'und') THEN 'dead' ELSE 'index' END AS place, count(DISTINCT id) AS ids FROM ok GROUP BY ALL""")
def p5(spark, sf_dir):
    """Texts the embedder refuses fail alone, are retried once and end in the dead-letter table."""
    base = ing.scratch(spark, "isolated")
    paths = si.Paths(*(f"{base}/{n}" for n in ("inbox", "index", "dead", "catalog", "metrics", "checkpoint")))
    fs.enqueue(ing.messages(spark, sf_dir), paths.inbox)
    for _ in range(2):
        si.run_to_end(si.ingest_stream(spark, paths, ing.FailsOn("und"), max_retries=2))
    index = spark.read.parquet(paths.index).select("id", F.lit("index").alias("place"))
    dead = spark.read.parquet(paths.dead).select("id", F.lit("dead").alias("place"))
    return index.unionByName(dead).groupBy("place").agg(F.countDistinct("id").alias("ids"))


@query("p6_streamed_catalog", _IDS + """ SELECT DISTINCT tenant, 'source' AS field, source AS value FROM ok WHERE rn = 1 UNION ALL SELECT DISTINCT tenant, 'doc_type', doc_type FROM ok WHERE rn = 1 AND doc_type <> ''
   UNION ALL SELECT tenant, 'date_min', min(date) FROM ok WHERE rn = 1 GROUP BY tenant UNION ALL SELECT tenant, 'date_max', max(date) FROM ok WHERE rn = 1 GROUP BY tenant""")
def p6(spark, sf_dir):
    return si.read_catalog(spark, ingested(spark, sf_dir).catalog)


@query("p7_ingest_metrics", _IDS + """ SELECT tenant, 'processed' AS status, count(DISTINCT id) AS n, true AS timed FROM ok GROUP BY tenant UNION ALL SELECT tenant, 'invalid', count(*), true FROM msg WHERE length(text) = 0 GROUP BY tenant""")
def p7(spark, sf_dir):
    rows = spark.read.parquet(ingested(spark, sf_dir).metrics)
    timed = (F.col("status") == "invalid") | ((F.col("embed_seconds") > 0) & (F.col("insert_seconds") > 0))
    return rows.groupBy("tenant", "status").agg(F.sum("n").alias("n"), F.bool_and(timed).alias("timed"))


@query("p7_observed_totals", _IDS + """ SELECT (SELECT count(DISTINCT (tenant, id)) FROM ok) AS processed, (SELECT count(*) FROM msg WHERE length(text) = 0) AS invalid, CAST(0 AS BIGINT) AS failed,
   (SELECT CAST(sum(length(text)) AS BIGINT) FROM ok WHERE rn = 1) AS chars""")
def p7_totals(spark, sf_dir):
    """Totals observed while the stages were written."""
    rows = spark.read.parquet(ingested(spark, sf_dir).totals)
    return rows.agg(*[F.sum(c).alias(c) for c in ("processed", "invalid", "failed", "chars")])


_CLOSED = "epoch_us(max(ts)) - 600000000 FROM events"


@query("p8_streamed_rate", f"""SELECT * FROM (SELECT event_type, epoch_us(ts) // 60000000 * 60 AS window_start, epoch_us(ts) // 60000000 * 60 + 60 AS window_end, count(*) AS n FROM events GROUP BY ALL) WHERE window_end * 1000000 <= (SELECT {_CLOSED})""")
def p8(spark, sf_dir):
    """Counts of the minutes closed by the watermark."""
    return sink(spark, sw.stream_rate(events(spark, sf_dir), ["event_type"]), "rate")


@query("p9_streamed_health", f"""SELECT * FROM (SELECT (s - o) * 60 AS window_start, (s - o) * 60 + 300 AS window_end, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n, count(*) FILTER (o = 4) AS n_recent
   FROM (SELECT event_type, epoch_us(ts) // 60000000 AS s, unnest(range(0, 5)) AS o FROM events) GROUP BY ALL) WHERE window_end * 1000000 <= (SELECT {_CLOSED})""")
def p9(spark, sf_dir):
    """Errors of five minutes beside the requests of the last one."""
    return sink(spark, sw.stream_health(events(spark, sf_dir), F.col("event_type") == "error", []), "health")


@query("p10_streamed_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
   s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
   SELECT user_id, epoch_us(min(ts)) // 1000000 AS window_start, (epoch_us(max(ts)) + 3600000000) // 1000000 AS window_end, count(*) AS n FROM s GROUP BY user_id, session HAVING epoch_us(max(ts)) + 3600000000 <= (SELECT {_CLOSED})""")
def p10(spark, sf_dir):
    return sink(spark, sw.stream_sessions(events(spark, sf_dir), ["user_id"]), "sessions")


@query("p11_streamed_reuse")
def p11(spark, sf_dir):
    """Reuse hits per user and event type with a day's life; equals the strict batch replay."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.unix_micros("ts").alias("us"), "user_id", "event_type")
    return sink(spark, sr.stream_reuse(rows, ["user_id", "event_type"], 86400), "reuse")


@query("p12_streamed_durations", LOG + uq._INTERVALS.replace("SELECT tenant, ts AS s", "SELECT request_id, ts AS s") + """, ended AS (SELECT * FROM iv WHERE request_id % 10 <> 0),
   closed AS (SELECT least((SELECT max(s) FROM iv), (SELECT max(e) FROM ended)) - INTERVAL 10 MINUTE AS w)
   SELECT request_id, (epoch_us(e) - epoch_us(s)) // 1000 AS duration_ms FROM ended UNION ALL SELECT request_id, NULL FROM iv, closed WHERE request_id % 10 = 0 AND s + INTERVAL 1 HOUR < w""")
def p12(spark, sf_dir):
    """Request starts and ends as two streams, every tenth request without an end; a latency second stands for a minute."""
    e = events(spark, sf_dir)
    starts = e.select(F.col("event_id").alias("request_id"), "ts")
    end = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") / 100 * 1000000).cast("long") * 60)
    ends = events(spark, sf_dir).filter(F.col("event_id") % 10 != 0).select(F.col("event_id").alias("request_id"), end.alias("ts"))
    return sink(spark, sw.stream_durations(starts, ends, "1 hour"), "durations")
