"""Registered ingestion, source and table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions import text as tx
from siftwell.operators import embed as em
from siftwell.operators import filters as fl
from siftwell.operators import ingest as ig
from siftwell.operators import ordered as od
from siftwell.plans import views as vw
from siftwell.plans.registry import query
from siftwell.session import scratch_folder, side_by_side
from siftwell.sources import files as fs
from siftwell.sources import ranges as rg
from siftwell.sources import tables as tb

DOCS, CHUNKS = "WITH " + vw.SQL_DOCUMENTS, "WITH " + vw.SQL_CHUNKS


def scratch(spark, label: str) -> str:
    """A folder of its own, which goes with the application's other tables."""
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def messages(spark, sf_dir):
    """Chunks as ingest messages; every ninth document lost its text, every fifth its type, to exercise defaults."""
    c = vw.chunks(spark, sf_dir)
    return c.select(
        "chunk_id", "tenant", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")).alias("text"), "source", "page",
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("doc_type")).alias("doc_type"), F.col("date").cast("string").alias("date"),
    )


_MSG = CHUNKS + """, msg AS (SELECT chunk_id, tenant, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text, source, page,
   CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_type END AS doc_type, CAST(date AS VARCHAR) AS date FROM chunks)"""


_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(
   regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
   '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("s2_html_documents", f"SELECT page_id, url AS source, 'html' AS doc_type, {_HTML} AS text FROM pages")
def s2(spark, sf_dir):
    pages = vw.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.col("url").alias("source"), F.lit("html").alias("doc_type"), fs.html_text(F.col("html")).alias("text"))


def page_files(spark, sf_dir):
    """The pages as eight text files, each in a folder of its own and ordered, whatever the number of tasks."""
    folder = scratch(spark, "html")
    pages = vw.table(spark, sf_dir, "pages").select("html", F.pmod("page_id", F.lit(8)).alias("part"), "page_id")
    ordered = pages.repartition(8, "part").sortWithinPartitions("part", "page_id")
    ordered.select("html", "part").write.partitionBy("part").text(folder)
    return folder


_FILES = "SELECT page_id % 8 AS part, string_agg(html || chr(10), '' ORDER BY page_id) AS body FROM pages GROUP BY ALL"


@query("s2_document_files", f"SELECT 'txt' AS doc_type, CAST(length(body) AS INTEGER) AS n_chars, md5(body) AS md5 FROM ({_FILES})")
def s2_files(spark, sf_dir):
    """The pages written as files, scanned back as documents."""
    return fs.load_documents(spark, page_files(spark, sf_dir)).select("doc_type", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


@query("s2_text_parts", f"SELECT count(*) AS files, CAST(sum(length(body)) AS BIGINT) AS n_chars, CAST(sum(length(body) - length(replace(body, chr(10), ''))) AS BIGINT) AS lines, true AS cut FROM ({_FILES})")
def s2_parts(spark, sf_dir):
    """The same files in parts of 16 KB, cut between lines: nothing is lost or read twice."""
    rows = rg.text_parts(spark, page_files(spark, sf_dir), range_bytes=16 << 10)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    whole = rows.agg(F.countDistinct("path").alias("files"), F.sum(F.length("text").cast("long")).alias("n_chars"), F.sum(lines.cast("long")).alias("lines"), (F.count("*") > F.countDistinct("path")).alias("cut"))
    return whole


@query("s1_file_scan", f"SELECT part, octet_length(encode(body)) AS size, sha1(body) AS sha1 FROM ({_FILES})")
def s1(spark, sf_dir):
    """Files below a folder, found by extension in any case, with size and fingerprint."""
    found = rg.file_hashes(spark, page_files(spark, sf_dir), "*.TXT")
    return found.select(F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part"), "size", "sha1")


@query("s3_golden_reader", f"SELECT regexp_replace(text, '^{vw._WS_SQL}|{vw._WS_SQL}$', '', 'g') AS query FROM benchmark WHERE text IS NOT NULL")
def s3(spark, sf_dir):
    """Benchmark texts written as JSON lines with broken lines among them, read back."""
    folder = scratch(spark, "golden")
    b = vw.table(spark, sf_dir, "benchmark")
    name = F.when(F.col("item_id") % 2 == 0, "query").otherwise("question")
    line = F.to_json(F.create_map(name, F.col("text")))
    b.select(F.explode(F.array(line, F.lit(""), F.concat(F.lit('{"query": '), F.col("item_id").cast("string")))).alias("value")).write.text(folder)
    return fs.read_golden(spark, folder).select("query")


@query("a5_golden_fingerprint", "SELECT sha1(string_agg(text || chr(10), '' ORDER BY item_id)) AS golden_hash FROM benchmark")
def a5(spark, sf_dir):
    folder = scratch(spark, "fingerprint")
    vw.table(spark, sf_dir, "benchmark").coalesce(1).sortWithinPartitions("item_id").select("text").write.text(folder)
    return fs.golden_hash(spark, folder).select("golden_hash")


@query("i1_recursive_chunks")
def i1(spark, sf_dir):
    docs = vw.texts(spark, sf_dir)
    return ig.chunk_recursive(docs.select("doc_id", "source", "text")).select("doc_id", "source", "ix", "text")


@query("i1_word_chunks", """WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (
     SELECT doc_id, list_filter(string_split(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents)),
   c AS MATERIALIZED (SELECT doc_id, i, word, CAST(sum(length(word) + CASE WHEN i = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reach FROM w),
   b AS MATERIALIZED (SELECT doc_id, i, reach, coalesce(lag(reach) OVER (PARTITION BY doc_id ORDER BY i), 0) AS start FROM c),
   lasts AS MATERIALIZED (SELECT s.doc_id, s.i, max(y.i) AS last FROM b s JOIN b y ON y.doc_id = s.doc_id AND y.i >= s.i AND y.i < s.i + 300 AND y.reach - s.start <= 300 GROUP BY ALL),
   nexts AS MATERIALIZED (SELECT f.doc_id, f.i AS last, min(x.i) AS i FROM b f JOIN b e ON e.doc_id = f.doc_id AND e.i = f.i + 1
     JOIN b x ON x.doc_id = f.doc_id AND x.i <= f.i + 1 AND x.i > f.i - 60 AND f.reach - x.start <= 60 AND e.reach - x.start <= 300 GROUP BY f.doc_id, f.i),
   steps AS MATERIALIZED (SELECT l.doc_id, l.i, l.last, n.i AS following FROM lasts l LEFT JOIN nexts n USING (doc_id, last)),
   p AS (SELECT doc_id, 0 AS ix, i, last, following FROM steps WHERE i = 0
     UNION ALL SELECT s.doc_id, p.ix + 1, s.i, s.last, s.following FROM p JOIN steps s ON s.doc_id = p.doc_id AND s.i = p.following)
   SELECT p.doc_id, CAST(ix AS INTEGER) AS ix, string_agg(word, ' ' ORDER BY c.i) AS text FROM p JOIN c ON c.doc_id = p.doc_id AND c.i BETWEEN p.i AND p.last GROUP BY p.doc_id, ix""")
def i1_words(spark, sf_dir):
    """The recursive splitter on texts whose only separator is a blank: 300 characters, 60 of overlap."""
    docs = vw.texts(spark, sf_dir).select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")).alias("text"))
    return ig.chunk_recursive(docs, 300, 60).select("doc_id", "ix", "text")


@query("i1b_fixed_chunks", CHUNKS + " SELECT chunk_id, doc_id, page, text FROM chunks")
def i1b(spark, sf_dir):
    return vw.chunks(spark, sf_dir).select("chunk_id", "doc_id", "page", "text")


@query("i2_validated_messages", _MSG + " SELECT chunk_id, sha1(text) AS id, source, page, coalesce(doc_type, '') AS doc_type, date FROM msg WHERE length(text) >= 1")
def i2(spark, sf_dir):
    valid, _ = ig.validate_ingest(messages(spark, sf_dir))
    return valid.select("chunk_id", "id", "source", "page", "doc_type", "date")


@query("i2_rejected_messages", _MSG + " SELECT chunk_id, 'empty_text' AS reason FROM msg WHERE length(text) = 0")
def i2_bad(spark, sf_dir):
    _, invalid = ig.validate_ingest(messages(spark, sf_dir))
    return invalid.select("chunk_id", "reason")


@query("i3_normalised_rows", DOCS + " SELECT doc_id, substr(sha256(sha1(text)), 1, 32) AS id, CAST(length(text) AS BIGINT) AS n_chars, CAST(-1 AS BIGINT) AS page FROM docs")
def i3(spark, sf_dir):
    rows, _ = ig.validate_ingest(vw.documents(spark, sf_dir).withColumn("date", F.col("date").cast("string")))
    return ig.normalise_rows(rows, id_chars=32).select("doc_id", "id", F.length("text").cast("long").alias("n_chars"), "page")


_SUFFIX = "source || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.HTML' WHEN 2 THEN '.htm' WHEN 3 THEN '.Docx' ELSE '' END"
_KIND = "CASE WHEN lower(name) LIKE '%.pdf' THEN 'pdf' WHEN lower(name) LIKE '%.html' OR lower(name) LIKE '%.htm' THEN 'html' WHEN lower(name) LIKE '%.docx' THEN 'docx' ELSE 'other' END"


def named_files(spark, sf_dir):
    d = F.col("doc_id") % 5
    suffix = F.when(d == 0, ".pdf").when(d == 1, ".HTML").when(d == 2, ".htm").when(d == 3, ".Docx").otherwise("")
    return vw.documents(spark, sf_dir).select("doc_id", F.concat("source", suffix).alias("name"))


@query("i4_doc_type_from_name", DOCS + f" SELECT doc_id, name, {_KIND} AS doc_type FROM (SELECT doc_id, {_SUFFIX} AS name FROM docs)")
def i4(spark, sf_dir):
    return named_files(spark, sf_dir).withColumn("doc_type", sc.doc_type_of(F.col("name")))


@query("i5_embedding_model", DOCS + f""" SELECT doc_id, doc_type, CASE doc_type WHEN 'pdf' THEN 'small' WHEN 'html' THEN 'small' WHEN 'docx' THEN 'large' ELSE 'small' END AS embed_model
   FROM (SELECT doc_id, {_KIND} AS doc_type FROM (SELECT doc_id, {_SUFFIX} AS name FROM docs))""")
def i5(spark, sf_dir):
    rows = named_files(spark, sf_dir).select("doc_id", sc.doc_type_of(F.col("name")).alias("doc_type"))
    return ig.select_embed_model(rows, "pdf:small, html:Small, docx:large, default:small")


@query("i7_reembedded_rows", "WITH " + vw.SQL_CHUNKS + " SELECT tenant, count(*) AS rows, CAST(32 AS INTEGER) AS dim FROM chunks WHERE length(text) > 0 GROUP BY tenant")
def i7(spark, sf_dir):
    """Chunks written as the active table, re-embedded into a new one, counted per tenant."""
    active, canary = scratch(spark, "active"), scratch(spark, "canary")
    tb.write_index(em.embed(vw.chunks(spark, sf_dir).select("chunk_id", "tenant", "text")), active)
    tb.write_index(em.reembed(spark.read.parquet(active), em.HashedCounts(32))[0], canary)
    return spark.read.parquet(canary).groupBy("tenant").agg(F.count("*").alias("rows"), F.min(F.size("embedding")).alias("dim"))


class FailsOn:
    """Embedder that refuses texts holding a word."""

    def __init__(self, word: str):
        self.word, self.inner = word, em.HashedCounts(16)

    def __call__(self, texts):
        if any(self.word in t for t in texts):
            raise ValueError("refused")
        return self.inner(texts)


@query("i7_build_record", "WITH " + vw.SQL_CHUNKS + " SELECT 'local' AS provider, 'counts-16' AS model, count(*) FILTER (NOT contains(text, 'und')) AS rows, count(*) FILTER (contains(text, 'und')) AS skipped FROM chunks WHERE length(text) > 0")
def i7_record(spark, sf_dir):
    """A re-embedding that some texts fail: they are skipped and counted."""
    built, failed = em.reembed(vw.chunks(spark, sf_dir).select("chunk_id", "tenant", "text"), FailsOn("und"))
    return em.build_record(built.select("chunk_id"), failed.select("chunk_id"), "local", "counts-16")


@query("i8_new_documents", DOCS + """, seen AS (SELECT DISTINCT sha1(text) AS id FROM docs WHERE date < DATE '2024-03-01')
   SELECT min(doc_id) AS doc_id, sha1(text) AS id, arg_min(source, doc_id) AS source FROM docs WHERE sha1(text) NOT IN (SELECT id FROM seen) GROUP BY sha1(text)""")
def i8(spark, sf_dir):
    """One row per text that an earlier load (before March) did not hold."""
    d = vw.documents(spark, sf_dir).withColumn("id", F.sha1(F.col("text").cast("binary")))
    seen = d.filter(F.col("date") < F.lit("2024-03-01").cast("date")).select("id").distinct()
    return ig.dedup_new(d.select("doc_id", "id", "source"), seen, keep="doc_id", unique=True).select("doc_id", "id", "source")


@query("i9_filter_catalog", _MSG + """ SELECT DISTINCT tenant, 'source' AS field, source AS value FROM msg WHERE source <> '' UNION ALL SELECT DISTINCT tenant, 'doc_type', doc_type FROM msg WHERE doc_type <> ''
   UNION ALL SELECT tenant, 'date_min', min(date) FROM msg GROUP BY tenant UNION ALL SELECT tenant, 'date_max', max(date) FROM msg GROUP BY tenant""")
def i9(spark, sf_dir):
    return ig.filter_catalog(messages(spark, sf_dir))


@query("i10_tenant_from_key", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'anon'
   ELSE substr(sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)), 1, 8) END AS tenant FROM customer""")
def i10(spark, sf_dir):
    """Customer names stand for API keys; every tenth key is missing."""
    key = F.when(F.col("c_custkey") % 10 != 0, F.col("c_name"))
    return vw.table(spark, sf_dir, "customer").select("c_custkey", sc.tenant_from_key(key).alias("tenant"))


@query("i11_token_estimate", DOCS + " SELECT doc_id, greatest(1, length(text) // 4) AS tokens, greatest(1, (length(text) + length(source)) // 4) AS list_tokens FROM docs")
def i11(spark, sf_dir):
    return vw.documents(spark, sf_dir).select(
        "doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"), tx.estimate_tokens(F.col("text"), F.col("source")).alias("list_tokens")
    )


@query("s4_index_scan", CHUNKS + " SELECT chunk_id, text, source, page FROM chunks")
def s4(spark, sf_dir):
    path = scratch(spark, "index")
    tb.write_index(vw.chunks(spark, sf_dir), path)
    return tb.scan_index(spark, path, ["chunk_id", "text", "source", "page"])


@query("s5_index_append", DOCS + " SELECT tenant, count(*) * 2 AS rows, count(DISTINCT doc_id) AS docs FROM docs GROUP BY tenant")
def s5(spark, sf_dir):
    """Two appends of the documents, counted per tenant folder."""
    path = scratch(spark, "append")
    docs = vw.documents(spark, sf_dir)
    tb.write_index(docs, path)
    tb.write_index(docs, path)
    return spark.read.parquet(path).groupBy("tenant").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"))


@query("s6_dual_write", DOCS + " SELECT 'primary' AS role, count(*) AS rows FROM docs UNION ALL SELECT 'secondary', count(*) FROM docs")
def s6(spark, sf_dir):
    one, two, log = scratch(spark, "one"), scratch(spark, "two"), scratch(spark, "writes")
    tb.dual_write(vw.documents(spark, sf_dir), one, two, log)
    done = [r["role"] for r in tb.successful_writes(spark, log).select("role").distinct().collect()]
    counted = [spark.read.parquet(p).agg(F.count("*").alias("rows")).withColumn("role", F.lit(r)) for p, r in ((one, "primary"), (two, "secondary")) if r in done]
    return counted[0].unionByName(counted[1]).select("role", "rows")


@query("s10_backup_restore", DOCS + " SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS excess FROM docs")
def s10(spark, sf_dir):
    docs = vw.documents(spark, sf_dir)
    target = tb.backup_index(docs, scratch(spark, "backup"), "2024-06-01")
    back = spark.read.parquet(target)
    return side_by_side(back.agg(F.count("*").alias("rows")), tb.validate_restore(docs, back, "doc_id")).select("rows", "missing", "excess")


@query("s10_repaired_restore", DOCS + """ SELECT count(*) AS rows, count(*) FILTER (doc_id % 50 = 7) + count(*) FILTER (doc_id % 90 = 11 AND doc_id % 50 <> 7) AS missing,
   count(*) FILTER (doc_id % 90 = 11 AND doc_id % 50 <> 7) + count(*) FILTER (doc_id % 70 = 3 AND doc_id % 50 <> 7) AS excess, CAST(0 AS BIGINT) AS missing_after, CAST(0 AS BIGINT) AS excess_after FROM docs""")
def s10_repaired(spark, sf_dir):
    """A restore that lost rows, changed some and holds others twice: found by key ranges, compared by row there, and repaired."""
    docs = vw.documents(spark, sf_dir)
    back = spark.read.parquet(tb.backup_index(docs, scratch(spark, "backup"), "2024-06-01"))
    kept = back.filter(F.col("doc_id") % 50 != 7)
    changed = kept.withColumn("text", F.when(F.col("doc_id") % 90 == 11, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    damaged = changed.unionByName(changed.filter(F.col("doc_id") % 70 == 3))
    found = tb.validate_restore(docs, damaged, "doc_id")
    mended = tb.repair_restore(docs, damaged, "doc_id")
    after = tb.validate_restore(docs, mended, "doc_id").select(F.col("missing").alias("missing_after"), F.col("excess").alias("excess_after"))
    return side_by_side(mended.agg(F.count("*").alias("rows")), found, after).select("rows", "missing", "excess", "missing_after", "excess_after")


@query("s11_enqueued_messages", _MSG + " SELECT tenant, count(*) AS messages, count(DISTINCT sha1(text)) AS ids FROM msg WHERE length(text) >= 1 GROUP BY tenant")
def s11(spark, sf_dir):
    folder = scratch(spark, "queue")
    fs.enqueue(messages(spark, sf_dir), folder)
    return spark.read.schema(fs.MESSAGE).json(folder).groupBy("tenant").agg(F.count("*").alias("messages"), F.countDistinct("id").alias("ids"))


@query("f1_filtered_chunks", CHUNKS + """ SELECT chunk_id, source, doc_type, date FROM chunks WHERE source IN ('src1', 'src4', 'src11') AND doc_type = 'en'
   AND date >= DATE '2024-02-01' AND date <= DATE '2024-10-31' AND tenant = 't1'""")
def f1(spark, sf_dir):
    f = fl.Filters(sources=["src1", "src4", "src11"], doc_type="en", date_from="2024-02-01", date_to="2024-10-31", tenant="t1")
    return fl.apply_filters(vw.chunks(spark, sf_dir), f).select("chunk_id", "source", "doc_type", "date")


_TEXT_DATE = "CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 'n/a' ELSE CAST(date AS VARCHAR) || 'T00:00:00' END"


@query("f2_text_date_filter", DOCS + f" SELECT doc_id, source FROM (SELECT *, {_TEXT_DATE} AS day FROM docs) WHERE TRY_CAST(substr(day, 1, 10) AS DATE) >= DATE '2024-05-01'")
def f2(spark, sf_dir):
    """Dates held as text: missing and invalid ones fail the bound."""
    m = F.col("doc_id") % 6
    day = F.when(m == 0, F.lit(None)).when(m == 1, "n/a").otherwise(F.concat(F.col("date").cast("string"), F.lit("T00:00:00")))
    d = vw.documents(spark, sf_dir).withColumn("day", day)
    return fl.apply_filters(d, fl.Filters(date_from="2024-05-01"), date="day").select("doc_id", "source")


@query("f3_refiltered_results", DOCS + """ SELECT doc_id, source FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN ['src2', 'src6', 'src8'] WHEN 1 THEN [] END AS fs,
     CASE WHEN doc_id % 2 = 0 THEN 'en' END AS fd, CASE WHEN doc_id % 5 = 0 THEN DATE '2024-06-01' END AS ff, CASE WHEN doc_id % 7 = 0 THEN DATE '2024-09-30' END AS ft FROM docs)
   WHERE (coalesce(len(fs), 0) = 0 OR list_contains(fs, source)) AND (fd IS NULL OR doc_type = fd) AND (ff IS NULL OR date >= ff) AND (ft IS NULL OR date <= ft)""")
def f3(spark, sf_dir):
    d = F.col("doc_id")
    rows = vw.documents(spark, sf_dir).withColumn(
        "f_sources", F.when(d % 3 == 0, F.array(F.lit("src2"), F.lit("src6"), F.lit("src8"))).when(d % 3 == 1, F.array().cast("array<string>"))
    ).withColumn("f_doc_type", F.when(d % 2 == 0, "en")).withColumn(
        "f_date_from", F.when(d % 5 == 0, F.lit("2024-06-01").cast("date"))
    ).withColumn("f_date_to", F.when(d % 7 == 0, F.lit("2024-09-30").cast("date")))
    return fl.refilter(rows).select("doc_id", "source")


@query("f4_denied_sources", DOCS + " SELECT doc_id, source FROM docs WHERE source NOT IN (SELECT source FROM docs GROUP BY source HAVING max(length(text)) > 20000)")
def f4(spark, sf_dir):
    """Sources holding a text of more than 20000 characters are denied."""
    docs = vw.documents(spark, sf_dir)
    deny = docs.groupBy("source").agg(F.max(F.length("text")).alias("longest")).filter("longest > 20000")
    return fl.exclude_denied(docs, deny).select("doc_id", "source")


_STRIPPED = f"""WITH c AS (SELECT conv_id, turn, regexp_replace(' ' || coalesce(text, '') || chr(10), '^{vw._WS_SQL}|{vw._WS_SQL}$', '', 'g') AS query FROM conversations)"""


def asked(spark, sf_dir):
    """Turns as queries, with white space at both ends."""
    padded = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n"))
    return vw.table(spark, sf_dir, "conversations").select("conv_id", "turn", padded.alias("query"))


@query("f6_valid_queries", _STRIPPED + " SELECT conv_id, turn, query FROM c WHERE length(query) BETWEEN 1 AND 1500")
def f6(spark, sf_dir):
    return fl.valid_queries(asked(spark, sf_dir), max_chars=1500)[0]


@query("f6_rejected_queries", _STRIPPED + " SELECT conv_id, turn, CASE WHEN query = '' THEN 'empty_query' ELSE 'query_too_long' END AS reason FROM c WHERE length(query) NOT BETWEEN 1 AND 1500")
def f6_rejected(spark, sf_dir):
    return fl.valid_queries(asked(spark, sf_dir), max_chars=1500)[1].select("conv_id", "turn", "reason")


@query("f9_stable_sample", "WITH " + vw.SQL_LOG + " SELECT request_id, tenant FROM log WHERE CAST('0x' || substr(md5('0:' || request_id), 1, 8) AS BIGINT) % 1000000 < 100000")
def f9(spark, sf_dir):
    return fl.sample_stable(vw.request_log(spark, sf_dir), 0.1, "request_id").select("request_id", "tenant")


@query("j4_semi_and_anti", DOCS + """, lab AS (SELECT doc_id FROM labels WHERE toxic = 0 AND quality = 1)
   SELECT doc_id, 'allowed' AS side FROM docs WHERE doc_id IN (SELECT doc_id FROM lab) UNION ALL SELECT doc_id, 'unlabelled' FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j4(spark, sf_dir):
    docs, labels = vw.documents(spark, sf_dir).select("doc_id"), vw.table(spark, sf_dir, "labels")
    good = docs.join(labels.filter("toxic = 0 AND quality = 1").select("doc_id"), "doc_id", "left_semi").withColumn("side", F.lit("allowed"))
    return good.unionByName(docs.join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("side", F.lit("unlabelled")))


@query("s12_newest_documents", DOCS + " SELECT tenant, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY date DESC, doc_id DESC) AS rn FROM docs) WHERE rn <= 20")
def s12(spark, sf_dir):
    return od.keep_latest(vw.documents(spark, sf_dir), 20, [F.col("date").desc(), F.col("doc_id").desc()], ["tenant"]).select("tenant", "doc_id")


@query("s12_newest_overall", vw.SQL_LOG.join(["WITH ", ""]) + " SELECT request_id FROM log ORDER BY ts DESC, request_id DESC LIMIT 1000")
def s12_global(spark, sf_dir):
    return od.keep_latest(vw.request_log(spark, sf_dir), 1000, [F.col("ts").desc(), F.col("request_id").desc()]).select("request_id")
