"""Ingestion transforms: splitting, validation, normalising, dedup, catalog."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.session import small_batches

# Defaults for chunking and the index columns.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
BLOCK_PIECES = 64
SEPARATORS = ["\n\n", "\n", " ", ""]


def chunk_fixed(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """Fixed-stride pieces: piece ``ix`` starts at ``ix * (size - overlap)``; no piece lies wholly in its overlap."""
    stride = size - overlap

    def pieces(length: Column, step: int, tail: int) -> Column:
        last = F.greatest(F.lit(0), F.ceil((length - tail) / F.lit(step)) - 1)
        return F.explode(F.sequence(F.lit(0), last.cast("int")))

    # Cut in two steps: finding a character position walks the text from its start, so cutting a very long text
    # straight into small pieces would take quadratic time.
    wide = stride * BLOCK_PIECES
    blocks = df.withColumn("__block", pieces(F.length(text), wide, overlap))
    blocks = blocks.withColumn(text, F.substring(F.col(text), F.col("__block") * wide + 1, F.lit(wide + overlap)))
    cut = blocks.withColumn("__ix", pieces(F.length(text), stride, overlap))
    cut = cut.withColumn(text, F.substring(F.col(text), F.col("__ix") * stride + 1, F.lit(size)))
    return cut.withColumn("ix", F.col("__block") * BLOCK_PIECES + F.col("__ix")).drop("__block", "__ix")


def _split_once(text: str, separators: list[str]) -> tuple[list[str], list[str]]:
    """Parts by the coarsest separator present (kept at each part's front) and the finer separators left."""
    for i, sep in enumerate(separators):
        if sep == "":
            return list(text), []
        if sep in text:
            first, *others = text.split(sep)
            parts = ([first] if first else []) + [sep + p for p in others]
            return parts, separators[i + 1 :]
    return [text], []


def _pack(parts: list[str], size: int, overlap: int) -> list[str]:
    """Greedy runs of parts up to ``size`` characters; each run restarts from a tail within ``overlap``."""
    out: list[str] = []
    start, used = 0, 0
    for i, part in enumerate(parts):
        if used + len(part) > size and used:
            piece = "".join(parts[start:i]).strip()
            if piece:
                out.append(piece)
            while used > overlap or (used and used + len(part) > size):
                used -= len(parts[start])
                start += 1
        used += len(part)
    piece = "".join(parts[start:]).strip()
    return out + ([piece] if piece else [])


def split_recursive(text: str, size: int, overlap: int, separators: list[str] | None = None) -> list[str]:
    """Split by paragraph, line, word, then character, merging neighbours up to ``size``."""
    parts, finer = _split_once(text, SEPARATORS if separators is None else separators)
    out: list[str] = []
    run: list[str] = []
    for part in parts:
        if len(part) < size:
            run.append(part)
            continue
        out += _pack(run, size, overlap)
        run = []
        out += split_recursive(part, size, overlap, finer) if finer else [part]
    return out + _pack(run, size, overlap)


def chunk_recursive(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """Recursive character split; every other column is copied to each piece, ``ix`` numbers the pieces."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t, size, overlap) if t else [])

    small_batches(df.sparkSession)
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(pieces(F.col(text))).alias("ix", text))


def ingest_rows(df: DataFrame) -> DataFrame:
    """Messages with defaults filled in: ``page`` -1, other missing text fields empty, id = SHA-1 of the text."""
    present = set(df.columns)

    def field(name: str, kind: str, default: object) -> Column:
        col = F.col(name) if name in present else F.lit(None)
        return F.coalesce(col.cast(kind), F.lit(default)).alias(name)

    fixed = {"id", "text", "source", "page", "doc_type", "date"}
    return df.select(
        F.coalesce(F.nullif(F.col("id"), F.lit("")) if "id" in present else F.lit(None), F.sha1(F.col("text").cast("binary"))).alias("id"),
        "text",
        field("source", "string", ""),
        field("page", "int", -1),
        field("doc_type", "string", ""),
        field("date", "string", ""),
        *[c for c in df.columns if c not in fixed],
    )


def validate_ingest(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): valid rows have non-empty text; invalid ones carry a ``reason``."""
    rows = ingest_rows(df)
    ok = F.coalesce(F.length("text") >= 1, F.lit(False))
    return rows.filter(ok), rows.filter(~ok).withColumn("reason", F.lit("empty_text"))


def normalise_rows(df: DataFrame, id_chars: int = 40) -> DataFrame:
    """Ids of bounded length: a longer one gives way to its SHA-256, so that distinct ids stay distinct. Texts stay whole."""
    return df.withColumn("id", F.when(F.length("id") > id_chars, F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, id_chars)).otherwise(F.col("id"))).withColumn("page", F.col("page").cast("long"))


def select_embed_model(df: DataFrame, spec: str, out: str = "embed_model") -> DataFrame:
    """Model size per ``doc_type`` from ``"type:size,…"``, then the map's default, then ``large``."""
    models = F.transform_values(sc.parse_map(spec), lambda k, v: F.lower(v))
    key = F.lower(F.coalesce(F.col("doc_type"), F.lit("")))
    wanted = F.when(key == "", F.lit("default")).otherwise(key)
    found = F.coalesce(
        F.nullif(F.try_element_at(models, wanted), F.lit("")),
        F.nullif(F.try_element_at(models, F.lit("default")), F.lit("")),
        F.lit("large"),
    )
    return df.withColumn(out, F.when(found == "small", "small").otherwise("large"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the first by ``order``, then by all other columns, so that it is always the same one."""
    others = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in others if c not in order])
    return df.groupBy(*keys).agg(F.min(ranked).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def dedup_new(df: DataFrame, seen: DataFrame | None, keep: str, key: str = "id", unique: bool = False) -> DataFrame:
    """One row per ``key`` (the smallest ``keep``) that ``seen`` does not hold yet.

    Copies collapse by a map-side partial aggregate, so a third of the corpus being one text costs one row per
    task. With ``unique`` (``keep`` identifies a row) only keys are aggregated and texts move once, to the rows that
    stay; that join is on (key, keep) and so has no hot key.
    """
    if unique:
        first = df.groupBy(key).agg(F.min(keep).alias(keep))
        if seen is not None:
            first = first.join(seen.select(key), key, "left_anti")
        return df.join(first, [key, keep], "left_semi")
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(keep)).alias("__r"))
    if seen is not None:
        first = first.join(seen.select(key), key, "left_anti")
    return first.select(key, "__r.*").select(*df.columns)


def catalog_parts(index: DataFrame, *extra: Column) -> DataFrame:
    """Distinct (tenant, field, value) entries of the filter catalog: sources, doc types, dates."""
    entry = F.explode(
        F.array(
            F.struct(F.lit("source").alias("field"), F.col("source").alias("value")),
            F.struct(F.lit("doc_type").alias("field"), F.col("doc_type").alias("value")),
            F.struct(F.lit("date").alias("field"), F.substring(F.col("date").cast("string"), 1, 10).alias("value")),
            *extra,
        )
    ).alias("e")
    return index.select("tenant", entry).select("tenant", "e.field", "e.value").filter(
        F.col("value").isNotNull() & (F.col("value") != "")
    ).distinct()


def filter_catalog(index: DataFrame) -> DataFrame:
    """Rows (tenant, field, value) of the filter catalog, as ``catalog_rows`` gives them; empty strings do not count."""
    return catalog_rows(catalog_parts(index))


def catalog_rows(parts: DataFrame) -> DataFrame:
    """Distinct sources and doc types of each tenant, a row each, and its first and last date as ``date_min`` and ``date_max``."""
    dates = parts.filter(F.col("field") == "date").groupBy("tenant").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    ends = F.inline(F.array(F.struct(F.lit("date_min").alias("field"), F.col("a").alias("value")), F.struct(F.lit("date_max").alias("field"), F.col("b").alias("value"))))
    return parts.filter(F.col("field") != "date").select("tenant", "field", "value").distinct().unionByName(dates.select("tenant", ends))
