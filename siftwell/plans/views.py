"""Domain views over the given tables, each with the same definition as SQL text."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.operators import bm25, cells, embed, ingest
from siftwell.session import checkpoint_root, delete_folder, spread


#: Room for a document's chunks in a chunk's id: eight billion characters.
CHUNKS_PER_DOCUMENT = 10_000_000
#: Documents of a folder of the index, and folders at most.
DOCUMENTS_PER_FOLDER, MOST_FOLDERS = 1000, 4096

_stored: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenant_of(col: str) -> Column:
    return F.concat(F.lit("t"), (F.col(col) % 4).cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tenant_of("doc_id").alias("tenant"),
        "source",
        F.col("lang").alias("doc_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"),
        "text",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is heavy per character."""
    return spread(documents(spark, sf_dir), "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ingest.chunk_fixed(texts(spark, sf_dir), 1000, 200)
    return cut.withColumnRenamed("ix", "page").withColumn("chunk_id", F.col("doc_id") * CHUNKS_PER_DOCUMENT + F.col("page"))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with their vectors as a written index, built once per application and corpus."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
        # Folders by ranges of documents: the text of a search's winners is read from theirs only.
        ids = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).first()
        folders = max(1, min(MOST_FOLDERS, ids["n"] // DOCUMENTS_PER_FOLDER))
        width = max(1, -(-((ids["last"] or 0) + 1) // folders))
        made = embed.embed(chunks(spark, sf_dir)).withColumn("folder", F.floor(F.col("doc_id") / width).cast("int"))
        made.write.partitionBy("folder").parquet(path)
        _stored[key] = path
        atexit.register(delete_folder, path)
    return spark.read.parquet(_stored[key])


def stored_cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    """The vectors as a written index of cells, built once per application and table."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#cells")
    if key not in _stored:
        path = f"{checkpoint_root(spark)}/cells-{uuid.uuid4().hex}"
        atexit.register(delete_folder, path)
        cells.build_cells(vectors(spark, sf_dir), path)
        _stored[key] = path
    return cells.open_cells(spark, _stored[key])


def stored_postings(spark: SparkSession, sf_dir: str) -> bm25.Postings:
    """The chunks' postings, written once per application and corpus."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#postings")
    if key not in _stored:
        path = f"{checkpoint_root(spark)}/postings-{uuid.uuid4().hex}"
        atexit.register(delete_folder, path)
        bm25.build_postings(chunks(spark, sf_dir), path)
        _stored[key] = path
    return bm25.Postings(_stored[key])


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        tenant_of("vec_id").alias("tenant"),
        F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("source"),
        (F.col("vec_id") % 7).cast("int").alias("page"),
        F.col("label").cast("string").alias("doc_type"),
        "embedding",
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    )
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        tenant_of("user_id").alias("tenant"),
        "user_id",
        F.concat(F.lit("question "), F.col("k").cast("string")).alias("query"),
        F.when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("type"), (F.col("k") % 5).cast("string"))).alias("doc_type"),
        F.when(F.col("event_type") == "view", "alpha").when(F.col("event_type") == "click", "beta")
        .when(F.col("event_type") == "signup", "gamma").otherwise("delta").alias("provider"),
        F.when(F.col("event_type") == "error", 500).when((F.col("event_type") == "signup") & (F.col("value") > 100), 429)
        .otherwise(200).cast("int").alias("status"),
        (F.col("value") / 100).alias("latency_s"),
        (F.col("k") * 40 + F.lit(20)).cast("long").alias("prompt_chars"),
        F.floor(F.col("value") * 10).cast("long").alias("answer_chars"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        tenant_of("doc_id").alias("tenant"),
        (F.col("quality") == 1).alias("helpful"),
        F.when(d % 3 == 0, "too long").when(d % 3 == 1, " off topic ").otherwise("").alias("reason"),
        F.when(d % 7 != 0, F.col("toxic") == 1).alias("hallucinated"),
        F.when(d % 2 == 0, (d % 5 + 1).cast("int")).alias("style_score"),
        F.when(d % 4 == 0, F.lit(None).cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("tag"), (d % 13).cast("string")), F.lit(" "), F.lit(" tone ")))
        .alias("tags"),
        F.timestamp_seconds(F.lit(1704067200) + d * 60).alias("ts"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows; every fourth exchange starts after a two hour pause."""
    c = table(spark, sf_dir, "conversations")
    # Joined on (conversation, turn) rather than windowed, so a very long conversation stays spread out.
    answers = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text")
    )
    c = c.filter(F.col("role") == "user").join(answers, ["conv_id", "turn"], "left")
    secs = F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn") * 1200 + F.floor(F.col("turn") / 4) * 7200
    return c.select(
        tenant_of("conv_id").alias("tenant"),
        F.col("conv_id").alias("user_id"),
        "turn",
        F.timestamp_seconds(secs).alias("ts"),
        F.col("text").alias("q"),
        F.coalesce("next_text", F.lit("")).alias("a"),
    )


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One judged pair per request: the scores come from the request's value and question number."""
    log = request_log(spark, sf_dir)
    control = F.round(F.least(F.col("latency_s"), F.lit(1.0)), 4)
    treatment = F.round((F.col("prompt_chars") % 1000) / 1000, 4)
    return log.select(
        "request_id", "tenant", "ts", control.alias("control_score"), treatment.alias("treatment_score")
    ).withColumn(
        "winner",
        F.when(F.abs(F.col("treatment_score") - F.col("control_score")) < 0.05, "tie")
        .when(F.col("treatment_score") > F.col("control_score"), "treatment")
        .otherwise("control"),
    )


# ---- the same views as SQL text, for checking --------------------------------------------------------

SQL_DOCUMENTS = """docs AS (
  SELECT doc_id, 't' || (doc_id % 4) AS tenant, source, lang AS doc_type,
         CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS date, text FROM documents)"""

SQL_CHUNKS = SQL_DOCUMENTS + """, chunks AS (
  SELECT doc_id, tenant, source, doc_type, date, CAST(i AS INTEGER) AS page,
         substr(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS text, doc_id * 10000000 + i AS chunk_id
  FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT)))) AS i FROM docs))"""

SQL_VECTORS = """vectors AS (
  SELECT vec_id, 't' || (vec_id % 4) AS tenant, 'src' || (vec_id % 20) AS source,
         CAST(vec_id % 7 AS INTEGER) AS page, CAST(label AS VARCHAR) AS doc_type,
         CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""

SQL_LOG = """log AS (
  SELECT event_id AS request_id, ts, 't' || (user_id % 4) AS tenant, user_id, 'question ' || k AS query,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'type' || (k % 5) END AS doc_type,
    CASE event_type WHEN 'view' THEN 'alpha' WHEN 'click' THEN 'beta' WHEN 'signup' THEN 'gamma' ELSE 'delta' END AS provider,
    CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' AND value > 100 THEN 429 ELSE 200 END AS status,
    value / 100 AS latency_s, k * 40 + 20 AS prompt_chars, CAST(floor(value * 10) AS BIGINT) AS answer_chars
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

SQL_FEEDBACK = """feedback AS (
  SELECT doc_id, 't' || (doc_id % 4) AS tenant, quality = 1 AS helpful,
    CASE doc_id % 3 WHEN 0 THEN 'too long' WHEN 1 THEN ' off topic ' ELSE '' END AS reason,
    CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END AS hallucinated,
    CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 5 + 1 AS INTEGER) END AS style_score,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ['tag' || (doc_id % 13), ' ', ' tone '] END AS tags,
    1704067200 + doc_id * 60 AS ts FROM labels)"""

SQL_TURNS = """turns AS (
  SELECT 't' || (conv_id % 4) AS tenant, conv_id AS user_id, turn,
    1704067200 + conv_id * 60 + turn * 1200 + (turn // 4) * 7200 AS ts, text AS q,
    CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS a
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""

SQL_JUDGE = SQL_LOG + """, judged AS (
  SELECT *, CASE WHEN abs(treatment_score - control_score) < 0.05 THEN 'tie'
                 WHEN treatment_score > control_score THEN 'treatment' ELSE 'control' END AS winner
  FROM (SELECT request_id, tenant, ts, round(least(latency_s, 1.0), 4) AS control_score,
               round((prompt_chars % 1000) / 1000.0, 4) AS treatment_score FROM log))"""

_WS_SQL = tx.WS.replace("'", "''")

# Hashed token counts of queries and chunks, their cosine, and the best 25 chunks per query.
SQL_CANDS = SQL_CHUNKS + f""", tq AS (SELECT item_id AS qid, text AS query FROM benchmark),
 qtok AS (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(query), '{_WS_SQL}'), lambda x: x <> '')) AS t FROM tq),
 ctok AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '{_WS_SQL}'), lambda x: x <> '')) AS t FROM chunks),
 qv AS (SELECT qid, CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % 64 AS b, count(*) AS c FROM qtok GROUP BY ALL),
 cv AS (SELECT chunk_id, CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % 64 AS b, count(*) AS c FROM ctok GROUP BY ALL),
 qn AS (SELECT qid, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM qv GROUP BY qid),
 cn AS (SELECT chunk_id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM cv GROUP BY chunk_id),
 sims AS (SELECT qid, chunk_id, round(CAST(sum(qv.c * cv.c) AS DOUBLE) / (any_value(qn.n) * any_value(cn.n)), 6) AS score
          FROM qv JOIN cv USING (b) JOIN qn USING (qid) JOIN cn USING (chunk_id) GROUP BY qid, chunk_id),
 allpairs AS (SELECT q.qid, c.chunk_id, coalesce(s.score, 0.0) AS score FROM tq q CROSS JOIN chunks c
              LEFT JOIN sims s ON s.qid = q.qid AND s.chunk_id = c.chunk_id),
 cands AS (SELECT qid, query, chunk_id, source, page, doc_type, date, tenant, text, score, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rk FROM allpairs)
    JOIN tq USING (qid) JOIN chunks USING (chunk_id) WHERE rk <= 25)"""
