"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over common words are compared with those of
its language by Jensen-Shannon distance. The references are gathered from the whole corpus. Guards: a histogram
over too few characters or words isn't judged, nor is a document whose language has no reference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import SPACE, WORD, cut

#: Common words of the languages that are judged. Their number bounds the reference table.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "with", "was"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "est", "une", "que"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "del", "los", "se", "las", "por", "un"],
}
VOCABULARY = list(dict.fromkeys(w for words in COMMON.values() for w in words))
#: One letter for each word of the vocabulary.
MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[: len(VOCABULARY)]
#: Character classes, each counted in what the earlier ones left over; the rest is a class of its own.
CLASSES = ["[a-z]+", "[A-Z]+", SPACE, "[0-9]+", r"\p{L}+", "[.,;:!?'\"()-]+", "[#*$%&|<>]+"]


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Distances above these reject; shorter texts aren't judged.
    char_distance: float = 0.33
    char_guard: int = 200
    word_distance: float = 0.4
    word_guard: int = 100


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of every whole text and the two histograms beside ``doc``, the row itself.

    Null text counts as empty. Columns of the input may have any names: they stay inside ``doc``.
    """
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[lang].alias("lang"), F.coalesce(docs[text], F.lit("")).alias("t"))
    df = df.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    df = df.withColumn("n", F.size("words")).withColumn("lines", F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    windows = F.arrays_zip(*[F.slice("words", i, F.col("n") - 2).alias(f"w{i}") for i in (1, 2, 3)], F.sequence(F.lit(1), F.col("n") - 2).alias("at"))
    windows = F.when(F.col("n") > 3, F.sort_array(windows))
    names = ["w1", "w2", "w3", "at"]
    df = df.withColumn("windows", windows.cast("array<struct<" + ",".join(f"{x}:{'int' if x == 'at' else 'string'}" for x in names) + ">>"))
    covered = F.expr(
        "size(array_distinct(flatten(filter(zip_with(slice(windows, 1, n - 3), slice(windows, 2, n - 3), (a, b) ->"
        " if(a.w1 = b.w1 and a.w2 = b.w2 and a.w3 = b.w3, array(a.at, a.at + 1, a.at + 2, b.at, b.at + 1, b.at + 2), null)), x -> x is not null))))"
    )
    left, sizes = F.col("t"), [F.length("t")]
    for pattern in CLASSES:
        left = F.regexp_replace(left, pattern, "")
        sizes.append(F.length(left))
    df = df.withColumn("left", F.array(*sizes))
    last = len(CLASSES)
    chars = F.expr(f"concat(transform(sequence(0, {last - 1}), i -> cast(left[i] - left[i + 1] as bigint)), array(cast(left[{last}] as bigint)))")
    listed = ", ".join(f"'{w}'" for w in VOCABULARY)
    df = df.withColumn("marks", F.expr(f"array_join(transform(filter(words, x -> lower(x) in ({listed})), x -> substring('{MARKS}', cast(array_position(array({listed}), lower(x)) as int), 1)), '')"))
    per_word = F.array(*[(F.length("marks") - F.length(F.replace("marks", F.lit(m), F.lit("")))).cast("long") for m in MARKS], (F.col("n") - F.length("marks")).cast("long"))
    return df.select(
        "doc",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") > 3, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.length("t").cast("long").alias("n_text"),
        chars.alias("chars"),
        per_word.alias("common"),
    )


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def references(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Summed histograms of each listed language over all documents that pass the base rules: at most ``len(COMMON)`` rows."""
    good = found.filter(F.col("lang").isin(*COMMON) & ~base_failed(limits))

    def summed(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(f"ref_{name}")

    return good.groupBy("lang").agg(summed("chars", len(CLASSES) + 1), summed("common", len(VOCABULARY) + 1))


def distance(own: str, reference: str) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms, null where either is empty."""
    share = lambda c: f"transform({c}, x -> x / total_{c})"
    terms = f"zip_with({share(own)}, {share(reference)}, (p, q) -> if(p > 0, p * ln(2 * p / (p + q)), 0D) + if(q > 0, q * ln(2 * q / (p + q)), 0D))"
    js = f"sqrt(greatest(0D, aggregate({terms}, 0D, (a, v) -> a + v)) / (2 * ln(2D)))"
    empty = f"{reference} is null or total_{own} = 0 or total_{reference} = 0"
    return F.expr(f"if({empty}, null, {js})")


def judge(found: DataFrame, refs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``found`` with both distances, ``base_failed`` and ``kept``."""
    df = found.join(F.broadcast(refs), "lang", "left")  # one row for each listed language at most
    for c in ("chars", "common", "ref_chars", "ref_common"):
        df = df.withColumn(f"total_{c}", F.expr(f"aggregate({c}, 0L, (a, v) -> a + v)"))
    df = df.withColumn("char_distance", F.when(F.col("n_text") >= limits.char_guard, distance("chars", "ref_chars")))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= limits.word_guard, distance("common", "ref_common")))
    far = (F.coalesce("char_distance", F.lit(0.0)) > limits.char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > limits.word_distance)
    return df.withColumn("base_failed", base_failed(limits)).withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document (``doc_id``) with counts, distances and verdict; texts are read once."""
    found = cut(features(docs.select("doc_id", "lang", "text")).withColumn("doc_id", F.col("doc.doc_id")).drop("doc"))
    return judge(found, references(found, limits), limits)


def accepted(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    found = cut(features(docs))  # with the documents: their texts are scanned by the rules once
    return judge(found, references(found, limits), limits).filter("kept").select("doc.*")
