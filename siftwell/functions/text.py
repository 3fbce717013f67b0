"""Text expressions: tokens, redaction, guardrails, intent, prompt assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() treats as white space.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Redaction patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\b(?:\+?\d[\s-]?){7,15}\b"
ID = r"\b[0-9A-Z]{8,}\b"
SECRET = r"""(?i)(api[_-]?key|secret|token)\s*[:=]\s*['"]?[A-Za-z0-9_\-]{8,}['"]?"""
PASSWORD = r"""(?i)(password)\s*[:=]\s*['"]?[^\s'"]{4,}['"]?"""

# Query expansion (any trigger contained in the lower-cased query appends the phrase).
EXPANSIONS = [
    (("uav", "drone"), "unmanned aerial vehicle"),
    (("gnc",), "guidance navigation and control"),
    (("aero",), "aerodynamics"),
]

# Intent terms.
TROUBLE_TERMS = ["error", "exception", "stack trace", "failed", "failure", "bug", "issue"]
EXPLORE_TERMS = ["overview", "explain", "guide", "walkthrough"]
EXPLORE_MIN_TOKENS = 20

# The phrases that frame a question.
CONTEXT_HEAD, CONTEXT_TAIL = "Previous context (most recent first):\n", "\n\nNew question: "
STYLE_HEAD, STYLE_TAIL = "Follow these tenant-specific instructions when answering:\n", "\n\nQuestion: "

# Fixed value: answer piece size in characters.
CHUNK_CHARS = 128


def strip(text: Column) -> Column:
    """The text without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{WS}|{WS}$", "")


def tokens(text: Column) -> Column:
    """Lower-cased white-space tokens, empty ones dropped."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WS), lambda t: t != "")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def tf_score(query: Column, text: Column) -> Column:
    """Sum over the query's tokens (repeats count) of substring occurrences in the lower-cased text."""
    body = F.lower(F.coalesce(text, F.lit("")))
    return F.aggregate(tokens(query), F.lit(0).cast("long"), lambda acc, t: acc + occurrences(body, t)).cast("double")


def redact_pii(text: Column) -> Column:
    out = F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")
    out = F.regexp_replace(out, PHONE, "[REDACTED_PHONE]")
    return F.regexp_replace(out, ID, "[REDACTED_ID]")


def redact_contacts(text: Column, word: str) -> Column:
    """E-mail and phone placeholders only, as policy tiers use them (``word`` is MASKED or REDACTED)."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), EMAIL, f"[{word}_EMAIL]")
    return F.regexp_replace(out, PHONE, f"[{word}_PHONE]")


def redact_secrets(text: Column) -> Column:
    out = F.regexp_replace(text, SECRET, "$1: [REDACTED_SECRET]")
    return F.regexp_replace(out, PASSWORD, "$1: [REDACTED_SECRET]")


def blocked_pattern(text: Column, patterns: Column) -> Column:
    """First non-empty pattern (array order, lower-cased) contained in the text, else NULL."""
    low = F.lower(F.coalesce(text, F.lit("")))
    lowered = F.transform(F.coalesce(patterns, F.array().cast("array<string>")), F.lower)
    return F.try_element_at(F.filter(lowered, lambda p: (p != "") & low.contains(p)), F.lit(1))


def _contains_any(low: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | low.contains(term)
    return hit


def expand_query(query: Column, table: Sequence[tuple[Sequence[str], str]] = tuple(EXPANSIONS)) -> Column:
    low = F.lower(query)
    extra = F.array_compact(F.array(*[F.when(_contains_any(low, keys), F.lit(phrase)) for keys, phrase in table]))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.array_join(extra, " "))).otherwise(query)


def classify_intent(query: Column) -> Column:
    low = F.lower(F.coalesce(query, F.lit("")))
    return (
        F.when(_contains_any(low, TROUBLE_TERMS), "troubleshoot")
        .when((F.size(tokens(query)) > EXPLORE_MIN_TOKENS) | _contains_any(low, EXPLORE_TERMS), "explore")
        .otherwise("lookup")
    )


def is_arithmetic(query: Column) -> Column:
    """True when the trimmed query holds only digits, operators, parentheses, dots and spaces."""
    return F.coalesce(strip(query).rlike(r"^[0-9\s+\-*/().]+$"), F.lit(False))


def history_block(turns: Column) -> Column:
    """``Q:``/``A:`` lines of an array of (q, a) structs."""
    lines = F.transform(
        turns,
        lambda e: F.concat(
            F.lit("Q: "), F.coalesce(e["q"], F.lit("")), F.lit("\nA: "), F.coalesce(e["a"], F.lit(""))
        ),
    )
    return F.array_join(lines, "\n")


def assemble_prompt(query: Column, turns: Column, style: Column) -> Column:
    """The question behind its recent turns, if any, and those behind the tenant's style text, if any."""
    asked = F.when(F.size(turns) > 0, F.concat(F.lit(CONTEXT_HEAD), history_block(turns), F.lit(CONTEXT_TAIL), query)).otherwise(query)
    wish = strip(F.coalesce(style, F.lit("")))
    return F.when(wish != "", F.concat(F.lit(STYLE_HEAD), wish, F.lit(STYLE_TAIL), asked)).otherwise(asked)


def estimate_tokens(*texts: Column) -> Column:
    total = F.lit(0)
    for t in texts:
        total = total + F.coalesce(F.length(t), F.lit(0))
    return F.greatest(F.lit(1), F.floor(total / 4)).cast("long")


def answer_chunks(text: Column) -> Column:
    """Words packed into pieces; a piece closes once its words plus one space each reach 128 characters.

    With single spaces between the words, a piece is all that is left, or 127 characters and the rest of the word that
    holds the last of them (of the next word, if that is a space). The text is scanned twice, however many pieces it has.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "))
    return F.regexp_extract_all(spaced, F.lit(rf"(?s) ?(.{{1,{CHUNK_CHARS - 1}}}[^ ]*)"), F.lit(1))
