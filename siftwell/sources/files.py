"""File sources: directory scans, text extraction, golden sets and the ingest landing folder."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import text as tx
from siftwell.operators import ingest
from siftwell.sources import ranges

MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("page", T.IntegerType()), T.StructField("doc_type", T.StringType()), T.StructField("date", T.StringType()),
        T.StructField("tenant", T.StringType()), T.StructField("attempts", T.IntegerType()),
    ]
)
GOLDEN = T.StructType(
    [
        T.StructField("query", T.StringType()), T.StructField("question", T.StringType()), T.StructField("tenant", T.StringType()),
        T.StructField("expected_sources", T.ArrayType(T.StringType())), T.StructField("expected_answer_contains", T.ArrayType(T.StringType())),
        T.StructField("expected_doc_type", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("__bad", T.StringType()),
    ]
)

# Decoder of one file: bytes in, page texts out.
Decoder = Callable[[bytes], list]


def scan_files(spark: SparkSession, path: str, ext: str = ".pdf") -> DataFrame:
    """Files below ``path`` whose name ends with ``ext`` in any case: path, source, modificationTime, content."""
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    return _binary(spark, path, pattern)


def _binary(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).withColumn("source", F.element_at(F.split("path", "/"), -1))


def html_text(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles and comments out, tags to spaces, five entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def load_documents(spark: SparkSession, path: str, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Documents of a folder: source, page, doc_type (extension), date (modification day), text.

    HTML and plain text are decoded by expressions. Other extensions need a decoder from ``decoders`` (extension to a
    callable); a file without one, or whose decoder fails, gives no row.
    """
    files = _binary(spark, path, None).withColumn(
        "doc_type", F.lower(F.regexp_extract("source", r"\.([^.]+)$", 1))
    ).withColumn("date", F.to_date("modificationTime").cast("string"))
    text_kinds, html_kinds = ["txt", "md", "csv", "json", "jsonl"], ["html", "htm"]
    known = files.filter(F.col("doc_type").isin(*text_kinds, *html_kinds))
    # A file whose bytes are no UTF-8 gives NULL and is dropped, like any file that cannot be read.
    body = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.when(F.col("doc_type").isin(*html_kinds), html_text(body)).otherwise(body)
    out = known.select("source", F.lit(-1).alias("page"), "doc_type", "date", text.alias("text")).filter(F.col("text").isNotNull())
    extra = {k.lower().lstrip("."): v for k, v in (decoders or {}).items()}
    if not extra:
        return out

    def decode(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    pages = extra[r.doc_type](bytes(r.content))
                except Exception:  # noqa: BLE001 - an unreadable file gives no row
                    continue
                rows += [(r.source, i, r.doc_type, r.date, t) for i, t in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["source", "page", "doc_type", "date", "text"])

    other = files.filter(F.col("doc_type").isin(*extra)).select("source", "doc_type", "date", "content")
    return out.unionByName(other.mapInPandas(decode, out.schema))


def read_golden(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Golden questions of JSON-lines files: blank and malformed lines and rows without a question are skipped."""
    raw = spark.read.schema(GOLDEN).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    rows = raw.filter(F.col("__bad").isNull()).withColumn(
        "query", tx.strip(F.coalesce(F.nullif("query", F.lit("")), F.col("question"), F.lit("")))
    ).filter(F.col("query") != "").drop("question", "__bad")
    return rows if limit is None else rows.limit(limit)


def golden_hash(spark: SparkSession, path: str) -> DataFrame:
    """SHA-1 of each golden file, read by ranges (see ``ranges.file_hashes``)."""
    return ranges.file_hashes(spark, path).select("source", F.col("sha1").alias("golden_hash"))


def enqueue(chunks: DataFrame, folder: str, refused: str | None = None) -> None:
    """Append validated chunks to the folder an ingest stream reads; invalid ones go to ``refused`` with a reason, if it is given."""
    valid, invalid = ingest.validate_ingest(chunks)
    fields = [F.col(f.name).cast(f.dataType) if f.name in valid.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MESSAGE.fields]
    valid.select(*fields).write.mode("append").json(folder, compression="gzip")
    if refused:
        invalid.select(*fields, "reason").write.mode("append").json(refused, compression="gzip")
