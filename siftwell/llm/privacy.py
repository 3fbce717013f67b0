"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card and phone numbers. A term of a document that holds an
entity discloses it as far as the corpus ties both together: their pointwise mutual information, over document counts,
as a share of the entity's own information. The share of a term's documents that hold the entity is judged by its lower
confidence bound, so that one meeting of a word that stands elsewhere, too, is no evidence, whatever the size of the corpus.
Terms above the first threshold are generalised, above the second removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import hashing
from siftwell.llm.bits import bits_of, fitting
from siftwell.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; e-mail is matched from its @ outwards, which gives the same matches in linear time.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile("[A-Za-z\u0080-\U0010ffff]{3,}")


@dataclass(frozen=True)
class Disclosure:
    #: Standard deviations below the observed share at which a term's share of documents with the entity is taken (Wilson's bound).
    doubt: float = 1.645
    #: A term discloses nothing if that share stays below this, however rare the entity is.
    certain: float = 0.1
    generalise: float = 0.5
    remove: float = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind and start, in code points."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity_of(kind: str, value: str) -> str:
    return kind + ":" + (value.lower() if kind in ("email", "ip") else "".join(c for c in value if c.isdigit()))


def term_hashes(terms: list[str]) -> list[int]:
    """The hashes that ``hashing.words`` gives the terms inside a text, as signed numbers."""
    data, offsets = hashing.text_bytes(pa.array(terms, pa.string()))
    return hashing.words(data, offsets, hashing.LETTERS)[0].view(np.int64).tolist()


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """Hashes of the distinct entities of the base spans."""
    names = {entity_of(kind, text[a:b]) for kind, a, b in spans}
    return sorted(int.from_bytes(hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for n in names)


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every term that lies in no base span, by hash and start."""
    covered = sorted((a, b) for _, a, b in spans)
    free, i = [], 0
    far = -1
    for m in TERM.finditer(text):
        a, b = m.span()
        while i < len(covered) and covered[i][0] < b:
            far = max(far, covered[i][1])
            i += 1
        if far <= a:
            free.append((a, b))
    hashes = np.array(term_hashes([text[a:b] for a, b in free]) if free else [], np.int64)
    order = np.argsort(hashes, kind="stable")
    places = np.array(free, np.int64).reshape(-1, 2)[order]
    return hashes[order], places[:, 0], places[:, 1]


FOUND = "rid long, doc_id long, text_key long, n_chars long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, terms array<struct<term:long,length:int,starts:array<int>>>"


def lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def grouped_terms(places: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """For each text's ``free_terms`` its distinct terms with their length and starts."""
    hashes, starts, ends = (np.concatenate([np.zeros(0, np.int64), *column]) for column in zip(*places, strict=True))
    row = np.repeat(np.arange(len(places)), [len(p[0]) for p in places])
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    held = lists(np.diff(np.append(first, len(hashes))), pa.array(starts, pa.int32()))
    terms = pa.StructArray.from_arrays([pa.array(hashes[first]), pa.array((ends - starts)[first], pa.int32()), held], names=["term", "length", "starts"])
    return lists(np.bincount(row[first], minlength=len(places)), terms)


def find(docs: DataFrame) -> DataFrame:
    """Per row its base spans and, if there are any, its entities and all its terms, kept once; ``rid`` tells rows with equal ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                texts = [t or "" for t in batch.column(3).to_pylist()]
                spans = [base_spans(t) for t in texts]
                none = (np.zeros(0, np.int64),) * 3
                held = [entities(t, s) for t, s in zip(texts, spans, strict=True)]
                counts = [pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64()) for k in KINDS]
                terms = grouped_terms([free_terms(t, s) if s else none for t, s in zip(texts, spans, strict=True)])
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [*(batch.column(i) for i in range(3)), sizes, *counts, pa.array([joined(s) for s in spans], pa.string()), pa.array(held, pa.list_(pa.int64())), terms]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "text_key", "n_chars", *[f"n_{k}" for k in KINDS], "base", "entities", "terms"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"])
    return cut(rows.mapInArrow(run, FOUND))


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n_term``: in how many documents each of ``terms`` stands, counted over all of them.

    A table of bits, sized by the number of terms up to a bound, goes to the tasks; terms that it doesn't know
    aren't counted. Counts are summed per batch before they are shuffled.
    """
    asked = cut(terms.select("term").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(asked, "term", fitting(asked.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.text_bytes(batch.column(0))
            hashes, rows, _ = hashing.words(data, offsets, hashing.LETTERS)
            signed = hashes.view(np.int64)
            keep = shared.value.has(hashes)
            row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[keep]
            signed = signed[keep]
            order = np.lexsort((row, signed))
            signed, row = signed[order], row[order]
            fresh = np.ones(len(signed), bool)
            fresh[1:] = (signed[1:] != signed[:-1]) | (row[1:] != row[:-1])
            values, counts = np.unique(signed[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def least_share(hits: Column, of: Column, z: float) -> Column:
    """Wilson's lower bound of the share hits / of."""
    share = hits / of
    spread = F.lit(z) * F.sqrt(share * (1 - share) / of + z * z / (4 * of * of))
    return (share + z * z / (2 * of) - spread) / (1 + z * z / of)


def disclosing(docs: DataFrame, found: DataFrame, plan: Disclosure) -> DataFrame:
    """``rid, start, end, action`` of the terms that disclose an entity of their own document too much, wherever they stand.

    With N documents, n_e of which hold the entity, n_t the term and n_te both, p is Wilson's lower bound of the share n_te / n_t, so
    that few documents tell less than many. Pointwise mutual information is log2(p N / n_e), and a tie is its
    share of log2(N / n_e); a term whose p is below ``certain`` isn't tied, for that share of log2(N) falls as the corpus grows.
    """
    held = found.select("rid", F.explode("entities").alias("entity"))
    # Entities of the same documents have the same ties: they are judged as one, by a hash of the documents.
    alike = held.groupBy("entity").agg(F.count("*").alias("n_entity"), *[F.bit_xor(F.xxhash64("rid", F.lit(i))).alias(f"x{i}") for i in range(2)])
    alike = cut(alike.select("entity", "n_entity", F.xxhash64("n_entity", "x0", "x1").alias("documents")))
    owned = held.join(alike, "entity").select("rid", "documents").distinct()
    near = cut(found.select("rid", "terms").join(owned, "rid").select("rid", "documents", F.inline("terms")))
    entities = alike.select("documents", "n_entity").distinct()
    ties = cut(near.groupBy("documents", "term").agg(F.count("*").alias("n_both")))
    counted = term_frequencies(docs, ties)
    n = F.lit(float(found.count()))
    tied = ties.join(entities, "documents").join(counted, "term")
    tied = tied.withColumn("p", least_share(F.col("n_both"), F.col("n_term"), plan.doubt)).filter(F.col("p") >= plan.certain)
    tied = tied.withColumn("tie", F.try_divide(F.log2(F.col("p") * n / F.col("n_entity")), F.log2(n / F.col("n_entity"))))
    tied = cut(tied.filter(F.col("tie") >= plan.generalise).select("documents", "term", "tie"))
    marked = near.join(tied, ["documents", "term"]).groupBy("rid", "term").agg(F.max("tie").alias("tie"), F.first("length").alias("length"), F.first("starts").alias("starts"))
    spans = marked.select("rid", "tie", "length", F.explode("starts").alias("start"))
    return spans.select("rid", F.col("start").cast("long").alias("start"), (F.col("start").cast("long") + F.col("length")).alias("end"), F.when(F.col("tie") >= plan.remove, F.lit("removed")).otherwise(F.lit("generalised")).alias("action"))


def sanitation(docs: DataFrame, plan: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: ``doc_id``, counts and ``base`` spans of the four kinds, ``terms``, the method's spans, and ``kept_share``, the
    share of the text's characters that none of them covers (1 for an empty text).

    ``base`` and ``spans`` list kind:start:end in code points, end exclusive; ``terms`` is an array of action, start and
    end by start. Null text counts as empty. Copies of a document count as documents. A frequent entity or
    term is counted before it is joined; entities of the same documents count as one.
    """
    docs = docs.select("doc_id", "text")
    found = find(docs)
    marked = disclosing(docs, found, plan)
    marked = marked.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("action", "start", "end"))).alias("terms"))
    out = found.drop("entities", "terms").join(marked, "rid", "left")
    listed = F.concat(F.filter(F.split("base", ","), lambda x: x != ""), F.coalesce(F.transform("terms", lambda x: F.concat_ws(":", x["action"], x["start"], x["end"])), F.array().cast("array<string>")))
    # The method's spans are words and overlap neither each other nor the base spans; base spans of different kinds may overlap.
    covered = F.aggregate(F.filter(F.split("base", ","), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: a + F.split(x, ":")[2].cast("long") - F.split(x, ":")[1].cast("long"))
    covered = covered + F.coalesce(F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0))
    kept = F.greatest(F.lit(0.0), 1 - covered / F.greatest(F.col("n_chars"), F.lit(1)))
    return out.select("rid", "doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base", "terms", kept.alias("kept_share"), F.sha2("base", 256).alias("base_sha256"), F.array_join(listed, ",").alias("spans"))


def replaced(text: str, spans: str) -> str:
    """The text with the listed spans replaced; where spans overlap, the earlier and then the longer one counts."""
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if a < at:
            continue
        put = "" if kind == "removed" else ("[Name]" if text[a].isupper() else "[term]") if kind == "generalised" else f"[{kind}]"
        out += [text[at:a], put]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, plan: Disclosure = Disclosure()) -> DataFrame:
    """The rows of ``docs`` with every column, their ``text`` sanitised; null text stays null.

    Rows are matched by id (or none) and text, so ids may repeat; equal rows are sanitised alike and stay as many as they were.
    """
    spans = sanitation(docs, plan).filter("spans <> ''").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.first("spans").alias("__spans"))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("__doc"), docs["text"].alias("__text"), docs["doc_id"].cast("long").alias("__row_id"), F.xxhash64(docs["text"]).alias("__row_key"))
    df = rows.join(spans, (F.col("__row_key") == F.col("__key")) & F.col("__row_id").eqNullSafe(F.col("__id")), "left")

    @F.pandas_udf("string")
    def put(text, listed):  # noqa: ANN001, ANN202
        return text.combine(listed, lambda t, s: t if t is None or not s else replaced(t, s))

    return df.select(*[(put("__text", "__spans") if n == "text" else F.col("__doc")[n]).alias(n) for n in names])
