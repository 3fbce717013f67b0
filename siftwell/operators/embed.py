"""Bulk embedding. An embedder is a callable from a pandas Series of texts to a list of vectors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import small_batches

Embedder = Callable[[pd.Series], list]


def token_bucket(token: str, dim: int) -> int:
    """Bucket of a token: the first eight hex digits of its MD5, modulo the dimension."""
    return int(hashlib.md5(token.encode("utf-8"), usedforsecurity=False).hexdigest()[:8], 16) % dim


class _Buckets(dict):
    """Token to bucket, filled on first use."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        found = self[token] = token_bucket(token, self.dim)
        return found

    def __reduce__(self):
        # Workers start with an empty table.
        return _Buckets, (self.dim,)


class HashedCounts:
    """Deterministic default embedder: counts of hashed lower-case tokens (scale-free under cosine)."""

    def __init__(self, dim: int = 64, cache: int = 50_000):
        self.dim = dim
        self.cache = cache
        self.known = _Buckets(dim)

    def __call__(self, texts: pd.Series) -> list:
        if len(self.known) > self.cache:
            self.known.clear()
        # Each distinct token of the batch is hashed once; all rows are counted at once.
        toks = [(t or "").lower().split() for t in texts]
        codes, vocabulary = pd.factorize(np.array(list(chain.from_iterable(toks)), dtype=object))
        buckets = np.array([self.known[t] for t in vocabulary], dtype=np.int64)
        row = np.repeat(np.arange(len(toks)), [len(t) for t in toks])
        counts = np.bincount(row * self.dim + (buckets[codes] if len(codes) else codes), minlength=len(toks) * self.dim)
        return list(counts.reshape(len(toks), self.dim).astype(np.float32))


def patient(model: Embedder, texts: pd.Series, tries: int, pause: float) -> list:
    """The embedder's vectors; a refused call is tried again after a pause that doubles each time."""
    for attempt in range(tries):
        try:
            return list(model(texts))
        except Exception:  # noqa: BLE001 - the last failure is raised
            if attempt == tries - 1:
                raise
            time.sleep(pause * 2**attempt)
    return []


def alone(model: Embedder, value: str | None):  # noqa: ANN201
    """One text's vector, or None where the embedder refuses it."""
    try:
        return list(model(pd.Series([value])))[0]
    except Exception:  # noqa: BLE001
        return None


def embed(
    df: DataFrame, embedder: Embedder | None = None, text: str = "text", out: str = "embedding", batch: int = 64,
    keep: list[str] | None = None, tries: int = 3, pause: float = 0.5, apart: bool = False,
) -> DataFrame:
    """Add ``out`` (ARRAY<FLOAT>), calling the embedder on slices of ``batch`` texts per Arrow batch, up to ``tries`` times.

    With ``apart``, a slice that fails to the end is redone text by text, and a text that fails alone has a null vector; without, it fails the job.

    The embedder object travels once per Python worker. Only texts go to Python and only vectors come back; the columns of ``keep`` (default: all) stay
    where they are.
    """
    model = embedder or HashedCounts()
    kept = df.columns if keep is None else keep

    @F.pandas_udf(T.ArrayType(T.FloatType(), False))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            made: list = []
            for i in range(0, len(texts), batch):
                part = texts.iloc[i : i + batch]
                try:
                    made += patient(model, part, tries, pause)
                except Exception:  # noqa: BLE001 - the failure belongs to single texts
                    if not apart:
                        raise
                    made += [alone(model, value) for value in part]
            yield pd.Series(made, dtype=object)

    small_batches(df.sparkSession)
    return df.select(*kept, vectors(F.col(text)).alias(out))


def embed_safely(df: DataFrame, embedder: Embedder, text: str = "text", batch: int = 64) -> DataFrame:
    """Add ``embedding``, ``error`` and ``embed_seconds`` (a text's share of its slice's time).

    A failing slice is redone text by text, so one bad text fails alone.
    """
    made_type = T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()), T.StructField("embed_seconds", T.DoubleType())])

    def one(value: str):
        try:
            return list(embedder(pd.Series([value])))[0], None
        except Exception as e:  # noqa: BLE001 - the failure belongs to this row only
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf(made_type)
    def outcomes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            made: list = []
            for i in range(0, len(texts), batch):
                part, start = texts.iloc[i : i + batch], time.perf_counter()
                try:
                    done = [(v, None) for v in embedder(part)]
                except Exception:  # noqa: BLE001
                    done = [one(v) for v in part]
                each = (time.perf_counter() - start) / len(part)
                made += [(*d, each) for d in done]
            columns = {f.name: pd.Series([m[i] for m in made], dtype="float64" if f.name == "embed_seconds" else object) for i, f in enumerate(made_type.fields)}
            yield pd.DataFrame(columns)

    small_batches(df.sparkSession)
    return df.withColumn("__made", outcomes(F.col(text))).select(*df.columns, "__made.*")


def reembed(active: DataFrame, embedder: Embedder | None = None, batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """(rows with fresh vectors, rows that failed with their ``error``); rows without text are skipped."""
    rows = active.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).drop("embedding")
    made = embed_safely(rows, embedder or HashedCounts(), batch=batch)
    failed = made.filter(F.col("error").isNotNull()).drop("embedding", "embed_seconds")
    return made.filter(F.col("error").isNull()).drop("error", "embed_seconds"), failed


def build_record(built: DataFrame, failed: DataFrame, provider: str, model: str) -> DataFrame:
    """One row on a build: provider, model, rows written and rows skipped."""
    sides = built.select(F.lit(1).alias("w"), F.lit(0).alias("s")).unionByName(failed.select(F.lit(0).alias("w"), F.lit(1).alias("s")))
    sums = sides.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("rows"), F.coalesce(F.sum("s"), F.lit(0)).alias("skipped"))
    return sums.select(F.lit(provider).alias("provider"), F.lit(model).alias("model"), "rows", "skipped")
