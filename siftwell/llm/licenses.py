"""License detection by ordered signature rules.

Rules are regular expressions over a text's words. A rule runs only where its keyword occurs. Of the detections, one
that lies inside a detection of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.license_rules import WRITTEN


@dataclass(frozen=True)
class Rule:
    label: str
    #: 0 is the highest.
    priority: int
    #: One of these stands in whatever the pattern matches.
    keywords: tuple[str, ...]
    pattern: str
    confidence: float


#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Family, keywords of which one stands in every detection, name in words, versions.
VERSIONED = [
    ("apache", ("apache",), "apache(?: software)?(?: foundation)?", ["1.0", "1.1", "2.0"]),
    ("gpl", ("gpl", "general public"), "(?:gnu )?(?:gpl|general public)", ["1.0", "2.0", "3.0"]),
    ("lgpl", ("lgpl", "lesser general", "library general"), "(?:gnu )?(?:lgpl|(?:lesser|library) general public)", ["2.0", "2.1", "3.0"]),
    ("agpl", ("agpl", "affero"), "(?:gnu )?(?:agpl|affero general public)", ["1.0", "3.0"]),
    ("gfdl", ("fdl", "free documentation"), "(?:gnu )?(?:gfdl|fdl|free documentation)", ["1.1", "1.2", "1.3"]),
    ("mpl", ("mpl", "mozilla"), "(?:mozilla public|mpl)", ["1.0", "1.1", "2.0"]),
    ("epl", ("epl", "eclipse"), "(?:eclipse public|epl)", ["1.0", "2.0"]),
    ("cddl", ("cddl", "common development"), "(?:common development and distribution|cddl)", ["1.0", "1.1"]),
    ("cpl", ("cpl", "common public"), "(?:common public|cpl)", ["1.0"]),
    ("eupl", ("eupl", "european union"), "(?:european union public|eupl)", ["1.0", "1.1", "1.2"]),
    ("osl", ("osl", "open software"), "(?:open software|osl)", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", ("afl", "academic free"), "(?:academic free|afl)", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", ("artistic",), "artistic", ["1.0", "2.0"]),
    ("ofl", ("ofl", "open font"), "(?:sil open font|open font|ofl)", ["1.0", "1.1"]),
    ("lppl", ("lppl", "latex project"), "(?:latex project public|lppl)", ["1.0", "1.1", "1.2", "1.3"]),
    ("zpl", ("zpl", "zope"), "(?:zope public|zpl)", ["1.1", "2.0", "2.1"]),
    ("cecill", ("cecill",), "cecill", ["1.0", "1.1", "2.0", "2.1"]),
    ("php", ("php",), "php", ["3.0", "3.01"]),
    ("psf", ("psf", "python software"), "(?:python software foundation|psf)", ["2.0"]),
    ("bsl", ("boost",), "boost(?: software)?", ["1.0"]),
    ("odbl", ("odbl", "open database"), "(?:open database|odbl)", ["1.0"]),
    ("odc-by", ("odc by", "open data commons"), "(?:open data commons attribution|odc by)", ["1.0"]),
]
#: Forms of a versioned license: suffix of the label, priority, pattern around name and version, confidence.
FORMS = [
    ("", 0, r"licen[cs]ed under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?(?: version)? v?{v}", 1.0),
    ("", 0, r"spdx license identifier {name} {v}", 1.0),
    ("-or-later", 0, r"{name}(?: licen[cs]e)?(?: version)? v?{v} or(?: at your option)?(?: any)? later(?: version)?", 1.0),
    ("-only", 0, r"{name}(?: licen[cs]e)?(?: version)? v?{v} only", 1.0),
    ("", 1, r"{name}(?: licen[cs]e)?(?: version)? v?{v}", 0.9),
]
#: Creative Commons: elements in identifiers and in words.
CREATIVE = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative)?s?",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
#: Label, keyword, pattern, priority, confidence of what has no versions.
PLAIN = [
    ("mit", "mit", r"(?:released|distributed|licen[cs]ed) under(?: the)?(?: terms of)?(?: the)? mit licen[cs]e", 0, 1.0),
    ("mit", "mit", r"spdx license identifier mit", 0, 1.0),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 0, 1.0),
    ("mit", "mit", r"mit licen[cs]e", 2, 0.7),
    ("mit-0", "mit", r"mit 0|mit no attribution", 1, 0.9),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", 2, 0.7),
    ("gpl", "gpl", r"gnu gpl|gpl ?v?[123]|gpl licen[cs]e", 2, 0.7),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", 2, 0.7),
    ("lgpl", "lgpl", r"lgpl(?: ?v?[23](?: 1)?)?", 2, 0.7),
    ("agpl", "agpl", r"agpl(?: ?v?[13])?", 2, 0.7),
    ("bsd-2-clause", "bsd", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd licen[cs]e", 1, 0.9),
    ("bsd-3-clause", "bsd", r"bsd 3 clause|3 clause bsd|(?:new|revised|modified) bsd", 1, 0.9),
    ("bsd-4-clause", "bsd", r"bsd 4 clause|4 clause bsd|original bsd licen[cs]e", 1, 0.9),
    ("bsd-0-clause", "bsd", r"0bsd|zero clause bsd|bsd zero clause", 1, 0.9),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", 2, 0.7),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1, 0.9),
    ("isc", "isc", r"isc licen[cs]e", 1, 0.9),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 1, 0.9),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 1, 0.9),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty", 2, 0.6),
    ("unlicense", "unlicense", r"the unlicense|unlicense", 1, 0.9),
    ("public-domain", "public domain", r"(?:released|placed|dedicated)(?: in)?(?: into)?(?: to)? the public domain", 1, 0.8),
    ("public-domain", "public domain", r"public domain", 3, 0.4),
    ("wtfpl", "wtfpl", r"wtfpl", 1, 0.9),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 1, 0.9),
    ("cc", "creative commons", r"creative commons(?: public)? licen[cs]e", 2, 0.6),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", 1, 0.9),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", 1, 0.9),
    ("beerware", "beer", r"beer ?ware(?: licen[cs]e)?", 1, 0.9),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", 1, 0.9),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[cs]e", 1, 0.9),
    ("proprietary", "rights reserved", r"all rights reserved", 3, 0.4),
    ("proprietary", "proprietary", r"proprietary(?: and)?(?: confidential)? licen[cs]e", 2, 0.6),
]


def build_rules() -> list[Rule]:
    """The rules written by hand (PLAIN and WRITTEN), every form of every version of every family, and names without a version."""
    rules = [Rule(label, priority, (keyword,), pattern, sure) for label, keyword, pattern, priority, sure in [*PLAIN, *WRITTEN]]
    for family, keywords, name, versions in VERSIONED:
        for version in versions:
            major, minor = version.split(".")
            number = f"{major}(?: {minor})" + ("?" if minor == "0" else "")
            for suffix, priority, form, sure in FORMS:
                rules.append(Rule(f"{family}-{version}{suffix}", priority, keywords, form.format(name=name, v=number), sure))
        rules.append(Rule(family, 2, keywords, rf"{name} licen[cs]e", 0.7))
    for short, long in CREATIVE.items():
        spaced = short.replace("-", " ")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ")
            rules.append(Rule(f"cc-{short}-{version}", 0, ("cc by",), rf"licen[cs]ed under(?: the)?(?: a)? cc {spaced} {number}", 1.0))
            rules.append(Rule(f"cc-{short}-{version}", 1, ("cc by",), rf"cc {spaced} {number}", 0.9))
            rules.append(Rule(f"cc-{short}-{version}", 1, ("creative commons",), rf"creative commons {long} (?:licen[cs]e )?(?:version )?{number}", 0.9))
        rules.append(Rule(f"cc-{short}", 2, ("cc by",), rf"cc {spaced}", 0.6))
        rules.append(Rule(f"cc-{short}", 2, ("creative commons",), rf"creative commons {long}", 0.7))
    return rules


#: Bytes of words stay (A-Z lower-cased); the others become spaces.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def whole_words(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


class Scanner:
    """Rules by keyword, and detections in one text."""

    def __init__(self, rules: list[Rule]) -> None:
        self.by_keywords: dict[tuple[bytes, ...], list[tuple[Rule, re.Pattern[bytes]]]] = defaultdict(list)
        for rule in rules:
            self.by_keywords[tuple(k.encode() for k in rule.keywords)].append((rule, whole_words(rule.pattern)))
        self.base = [(p.encode(), whole_words(p), label) for p, label in BASE.items()]

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode("utf-8", "surrogatepass").translate(KEPT).split()
        line = b" ".join(words)
        base, found = [], []
        if line:
            for phrase, pattern, label in self.base:
                if phrase in line:
                    base += [(line.count(b" ", 0, m.start()), label) for m in pattern.finditer(line)]
            for keywords, rules in self.by_keywords.items():
                if any(k in line for k in keywords):
                    for rule, pattern in rules:
                        for m in pattern.finditer(line):
                            found.append((m.start(), m.end(), rule.priority, rule.label, rule.confidence))
        kept = suppressed(found)
        first = [at for at, _ in base]
        spans = [{"label": x[3], "priority": x[2], "start_word": line.count(b" ", 0, x[0]), "end_word": line.count(b" ", 0, x[1]) + 1, "confidence": x[4]} for x in kept]
        base_labels = {label for _, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(first, default=None),
            "last_word": max(first, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | {x["label"] for x in spans})),
            "score": max([x["confidence"] for x in spans] + [0.7] * bool(base), default=0.0),
            "spans": spans,
        }


def suppressed(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Detections that don't lie inside one of the same or a higher priority; of equal intervals the first by confidence and label stays."""
    kept: list[tuple[int, int, int, str, float]] = []
    for priority in sorted({x[2] for x in found}):
        stronger = sorted((x[0], x[1]) for x in kept)
        starts, reach, most = [x[0] for x in stronger], [], -1
        for _, end in stronger:
            most = max(most, end)
            reach.append(most)
        far = -1
        for x in sorted((x for x in found if x[2] == priority), key=lambda x: (x[0], -x[1], -x[4], x[3])):
            before = bisect_right(starts, x[0])
            if x[1] > far and (not before or reach[before - 1] < x[1]):
                kept.append(x)
                far = x[1]
    return sorted(kept)


SPANS = "array<struct<label:string,priority:int,start_word:long,end_word:long,confidence:double>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("confidence", pa.float64())])))]
)


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: counts and places of the base phrases, labels, ``score`` and the accepted ``spans`` in words.

    Null text counts as empty: no words, no labels ('' each), null places, score 0. Rows are independent of each other,
    so equal ids, copies and hot sources need nothing. ``score`` is the confidence of the surest detection.
    """
    chosen = rules if rules is not None else build_rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            rows = [{"doc_id": i} | scanner.scan(t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)
