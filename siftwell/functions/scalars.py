"""Vector, array, hash, date and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS name space of RFC 4122, hashed in front of the key for a version 5 UUID.
UUID_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0.0 for empty, unequal-length or zero vectors."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    scale = norm(a) * norm(b)
    return F.when(usable & (scale > 0), dot(a, b) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def sorted_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two arrays as sets; an empty union counts as size one."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def tenant_from_key(key: Column) -> Column:
    """First eight hex digits of the version 5 UUID of an API key; ``anon`` for a missing key."""
    hashed = F.sha1(F.concat(F.unhex(F.lit(UUID_DNS)), F.encode(key, "UTF-8")))
    return F.when(F.coalesce(key, F.lit("")) == "", "anon").otherwise(F.substring(hashed, 1, 8))


def request_key(*parts: Column) -> Column:
    """SHA-256 over the JSON of the named parts, in name order (missing parts stay out)."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def exact_key(query: Column, filters: Column) -> Column:
    """First 16 hex digits of the SHA-1 over the query, a pipe and its filters' JSON."""
    return F.substring(F.sha1(F.concat(F.coalesce(query, F.lit("")), F.lit("|"), filters)), 1, 16)


def parse_map(spec: str | Column) -> Column:
    """``"k:v, k:v"`` as a map with trimmed keys and values."""
    col = F.lit(spec) if isinstance(spec, str) else spec
    raw = F.str_to_map(F.regexp_replace(F.trim(col), r"\s*([,:])\s*", "$1"), F.lit(","), F.lit(":"))
    return F.map_filter(raw, lambda k, v: k != "")


def iso_day(text: Column) -> Column:
    """Date of the first ten characters; NULL when they are no date."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def doc_type_of(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return (
        F.when(low.endswith(".pdf"), "pdf")
        .when(low.endswith(".html") | low.endswith(".htm"), "html")
        .when(low.endswith(".docx"), "docx")
        .otherwise("other")
    )
