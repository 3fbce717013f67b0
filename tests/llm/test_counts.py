"""Operators on single documents and on sizes: quality, packing, mixing, sharding, licenses, privacy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.llm import licenses, mixing, packing, privacy, quality, sharding
from siftwell.llm.twins import SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, words string, shard int"
PROSE = "the of and to a in is that it for with was on as by he be at from this have which or had not"


def documents(spark, rows):
    """Documents with columns whose names operators use inside, too."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", -1) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    words = PROSE.split() + ["Zyx", "qqq", "ünter", "été", "#", "$$", "12.5", "a,b"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))

    rows = [(i, text(rng.choice([0, 1, 3, 60, 120, 300])), rng.choice(["en", "fr", None, "xx"]), rng.choice(["a", "b", None, "ü", "a"])) for i in range(60)]
    rows += [(100, None, "en", "a"), (101, "", None, None), (None, text(80), "en", "b"), (102, "word " * 5000, "en", "a"), (103, "\n\n \n", "de", "c"), (104, "x" * 30000, "en", "c")]
    rows += [(105, PROSE * 3, "en", "a"), (105, PROSE * 3, "en", "a")]
    return rows


def by_duckdb(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return sorted(repr(sorted(zip(names, r, strict=True))) for r in rel.fetchall())


def plain(df, names):
    return sorted(repr(sorted((n, r[n]) for n in names)) for r in df.select(*names).collect())


def repeat_words(words):
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_quality_equals_sql_and_counts(spark, odd_rows):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality.quality(documents(spark, odd_rows))
    assert plain(got, names) == by_duckdb(odd_rows, SQL["op1_quality_divergence"])
    by_id = {r.doc_id: r for r in got.collect()}
    for i, text, _, _ in odd_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert by_id[i].n_words == len(words) and by_id[i].n_repeat_words == repeat_words(words)
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert by_id[i].n_dup_lines == len(lines) - len(set(lines))


def test_quality_stage_keeps_columns_and_rejects_what_diverges(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(PROSE.split()) + f" w{rng.randint(0, 10**6)}" for _ in range(80)), "en", "a") for i in range(30)]
    symbols = (50, " ".join(f"q{rng.randint(0, 10**6)}%%%%%%%%" for _ in range(150)), "en", "a")
    unknown = (51, symbols[1], "xx", "a")
    docs = documents(spark, [*good, symbols, unknown])
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 51]


def test_distance_is_jensen_shannon(spark):
    p, q = [1, 2, 0, 5], [4, 0, 1, 3]
    df = spark.createDataFrame([(p, q, sum(p), sum(q)), ([0, 0, 0, 0], q, 0, sum(q))], "p array<long>, q array<long>, total_p long, total_q long").select(quality.distance("p", "q"))
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    expected = sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(a, b, strict=True))
    rows = df.collect()
    assert rows[0][0] == pytest.approx(math.sqrt(expected / 2)) and rows[1][0] is None


def test_empty_tables(spark):
    docs = documents(spark, [])
    for df in (quality.quality(docs), quality.accepted(docs), mixing.mix(docs), mixing.training_order(docs), packing.pack(docs), sharding.shard(docs, 4), licenses.scan_licenses(docs), privacy.sanitation(docs)):
        assert df.count() == 0


def test_mix_equals_sql_and_reaches_its_targets(spark, odd_rows):
    names = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    got = mixing.mix(documents(spark, odd_rows))
    sql = "SELECT doc_id, size, source_size, target, taken, copies FROM (" + SQL["op3_curriculum_mix"] + ")"
    assert plain(got, names) == by_duckdb(odd_rows, sql)
    taken, target = Counter(), {}
    for r in got.collect():
        assert 0 <= r.taken <= 3 * r["size"]
        assert all(0 <= p < 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(target.values()) == pytest.approx(sum(len((t or "").split()) for _, t, _, _ in odd_rows))


def test_mix_merges_its_sources_into_one_order(spark, odd_rows):
    """Places are gapless over all sources, and each stretch of the order holds them in ratio of their weights at that time."""
    even = [(i, "w " * (1 + i % 5), "en", s) for i, s in enumerate(["a"] * 500 + ["b"] * 3000 + [None] * 3000)]
    for rows in (odd_rows, even):
        got = mixing.mix(documents(spark, rows)).collect()
        steps = []
        for r in got:
            assert len(r.places) == len(r.positions) and (r.taken > 0) == bool(r.places)
            words = [min(r["size"], r.taken - e * r["size"]) for e in range(len(r.places))]
            steps += zip(r.places, r.positions, words, [r.source] * len(words), strict=True)
        steps.sort(key=lambda x: x[0])
        before = 0
        for place, _, n, _ in steps:
            assert place == before and n > 0
            before += n
        assert [x[1] for x in steps] == sorted(x[1] for x in steps)
    schedules, target = mixing.Curriculum().schedules, {r.source: r.target for r in got}
    assert target["a"] == 3 * sum(1 + i % 5 for i in range(500))
    for tenth in range(10):
        t = (tenth + 0.5) / 10
        for source, knots in zip(["a", "b", None], schedules, strict=True):
            weight = next(w0 + (w1 - w0) * (t - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False) if t <= t1)
            words = sum(n for _, p, n, s in steps if s == source and t - 0.05 <= p < t + 0.05)
            assert words == pytest.approx(target[source] * weight / 10, abs=12)


def test_schedule_is_inverted(spark):
    for knots in mixing.Curriculum().schedules + (((0.0, 1.0), (0.25, 3.0), (1.0, 0.5)),):
        steps = [i / 50 for i in range(51)]

        def weight(t, knots=knots):
            return next(w0 + (w1 - w0) * (t - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False) if t <= t1)

        fine = 20000
        sums = [0.0]
        for i in range(fine):
            sums.append(sums[-1] + weight((i + 0.5) / fine) / fine)
        from pyspark.sql import functions as F

        shares = [(sums[int(t * fine)] / sums[-1],) for t in steps]
        got = [r[0] for r in spark.createDataFrame(shares, "s double").select(mixing.when_drawn(F.col("s"), knots)).collect()]
        assert max(abs(a - b) for a, b in zip(got, steps, strict=True)) < 1e-3


def test_training_order_repeats_and_sorts(spark):
    rows = [(i, "w " * (5 + i % 7), "en", s) for i, s in enumerate(["a"] * 40 + ["b"] * 200 + [None] * 20)]
    docs = documents(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    ordered = mixing.training_order(docs)
    assert ordered.columns == docs.columns
    got = [r.doc_id for r in ordered.collect()]
    assert Counter(got) == Counter({i: n for i, n in copies.items() if n})
    first = {r.doc_id: r.positions[0] for r in mixing.mix(docs).collect() if r.positions}
    seen = list(dict.fromkeys(got))
    assert [first[i] for i in seen] == sorted(first[i] for i in seen)


def naive_best_fit(sizes, sources, clusters, capacity):
    """The tightest bin that is large enough and compatible; of equally tight ones, that which has been so for longest."""
    least = max(1, -(-sum(sizes) // capacity))
    places = {s: -(-n // least) for s, n in Counter(sources).items()}
    bins, out = [], []
    for step, (size, source, cluster) in enumerate(zip(sizes, sources, clusters, strict=True)):
        fits = [b for b in range(len(bins)) if capacity - bins[b][0] >= size and (cluster < 0 or cluster not in bins[b][1]) and bins[b][2][source] < places[source]]
        if not fits:
            bins.append([0, set(), Counter(), 0])
            fits = [len(bins) - 1]
        b = min(fits, key=lambda b: (capacity - bins[b][0], bins[b][3]))
        bins[b][0] += size
        bins[b][1].add(cluster)
        bins[b][2][source] += 1
        bins[b][3] = step
        out.append(b)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(5)
    for _ in range(200):
        n, capacity = rng.randint(1, 80), rng.choice([10, 64, 100])
        sizes = sorted((rng.randint(0, capacity) for _ in range(n)), reverse=True)
        sources, clusters = [rng.choice([0, 0, 0, 1, 2]) for _ in sizes], [rng.choice([-1, -1, 0, 1]) for _ in sizes]
        assert packing.best_fit(sizes, sources, clusters, capacity) == naive_best_fit(sizes, sources, clusters, capacity)


def test_repeated_rows_fill_many_groups(spark):
    docs = documents(spark, [(7, "same text " * 20, "en", "a")] * 400 + [(None, None, "en", "a")] * 100)
    got = packing.pack(docs, packing.Packing(capacity=100, group_pieces=20)).collect()
    groups = Counter(r.bin_id >> 24 for r in got)
    assert len(got) == 500 and len(groups) >= 20 and max(groups.values()) < 60


def test_bins_follow_the_order_of_files(spark, tmp_path):
    rows = [(i, "word " * 10, "en", f"s{i % 3}", 10 if i % 7 else 30) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    df.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "docs")), packing.Packing(capacity=50, group_pieces=50), along_files=True).collect()
    spans = defaultdict(list)
    for r in got:
        spans[r.bin_id >> 24].append(r.doc_id)
    assert len(got) == 600 and len(spans) >= 10
    for g, ids in spans.items():
        assert max(ids) - min(ids) + 1 == len(ids) <= 60, g  # a stretch of the order
    assert [min(spans[g]) for g in sorted(spans)] == sorted(min(ids) for ids in spans.values())


def test_pack_covers_every_word_once(spark, odd_rows):
    docs = documents(spark, odd_rows)
    got = packing.pack(docs, packing.Packing(capacity=100, group_pieces=20)).collect()
    words = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        words[r.doc_id].append((r.start_word, r.n_words))
        bins[r.bin_id].append(r)
    expected = Counter()
    for i, t, _, _ in odd_rows:
        expected[i] += len((t or "").split())
    assert {i: sum(n for _, n in w) for i, w in words.items()} == dict(expected)
    texts = {i: t or "" for i, t, _, _ in odd_rows}
    for rows in bins.values():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(len(rows))) and sum(r.n_words for r in rows) <= 100
        assert [r.offset for r in rows] == [sum(x.n_words for x in rows[:k]) for k in range(len(rows))]
        held = [texts[r.doc_id] for r in rows]
        assert len(held) == len(set(held))  # a cluster stands in a bin once


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 200), rng.choice(["en", "fr"]), rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(3000)]
    rows += [(None, None, None, None)] + [(5000 + i, "same text", "en", "hot") for i in range(1500)]
    got = sharding.shard(documents(spark, rows), 40).collect()
    assert len(got) == len(rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r.slot)
    assert sorted(load) == list(range(40)) and max(load.values()) - min(load.values()) < 0.1 * sum(load.values()) / 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r.doc_id: r for r in got}
    for i, t, _, _ in rows:
        data = (t or "").encode()
        assert (by_id[i]["size"], by_id[i].text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert sharding.shard(documents(spark, rows), target_bytes=100_000).select("shard").distinct().count() == -(-sum(load.values()) // 100_000)


def test_more_shards_than_the_driver_holds_nodes(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "x" * rng.choice([10, 50, 300]), rng.choice(["en", "fr"]), f"s{i % 5}") for i in range(700)]
    monkeypatch.setattr(sharding, "MOST_SHARDS", 4)
    got = sharding.shard(documents(spark, rows), 13).collect()
    load, held = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r.size
        held[r["shard"]].append(r.slot)
    assert len(got) == 700 and set(load) == set(range(13)) and all(sorted(s) == list(range(len(s))) for s in held.values())
    assert max(load.values()) - min(load.values()) <= 3 * 316  # a document at each of the cuts above a shard
    assert sharding.shard(documents(spark, []), 13).count() == 0


def test_cuts_follow_the_widest_dimension_at_the_weighted_median(spark):
    """Half of the bytes lie below the first cut along the dimension with the widest spread, as brute force finds it."""
    rng = random.Random(7)
    rows = [([rng.randrange(100) << 32, rng.randrange(60_000) << 32, rng.randrange(500) << 32], rng.randint(1, 50)) for _ in range(900)]
    df = spark.createDataFrame(rows, "keys array<long>, size long")
    out, nodes = sharding.grow(df, 3, 4)
    got = [(r["keys"], r["size"], r["node"]) for r in out.collect()]
    assert nodes == [(0, 1), (1, 1), (2, 1), (3, 1)]

    def split(part, d):
        total, seen = sum(s for _, s in part), 0
        for key, size in sorted((k[d], s) for k, s in part):
            if seen + size > total / 2:
                return key, seen / total
            seen += size
        raise AssertionError

    key, _ = split(rows, 1)
    low = [(k, s) for k, s, n in got if n < 2]
    assert max(k[1] for k, _ in low) < min(k[1] for k, _, n in got if n >= 2)
    assert abs(sum(s for _, s in low) - sum(s for _, s in rows) / 2) <= 50 and abs(max(k[1] for k, _ in low) - key) >> 32 < 1000
    for pair in ((0, 1), (2, 3)):  # still the widest within each half
        a, b = ([k[1] for k, _, n in got if n == x] for x in pair)
        assert max(a) < min(b)


def test_shards_of_one_document_many_times(spark):
    got = sharding.shard(documents(spark, [(7, "abc", "en", "a")] * 30), 4).collect()
    assert len(got) == 30 and all(0 <= r["shard"] < 4 for r in got)


LICENSED = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License. MIT license; mit-license",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "Mozilla Public License Version 2.0 and the BSD 3-Clause licence, all rights reserved",
    "no terms here, Ümit LicenKe",
    "",
    None,
    "mit " * 4000 + "license",
]


def test_licenses(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, [(i, t, "en", "a") for i, t in enumerate(LICENSED)])).collect()}
    assert got[0].labels == "apache,apache-2.0" and got[0].base_labels == "apache" and (got[0].n_base, got[0].first_word) == (1, 3)
    assert got[1].labels == "gpl,gpl-3.0" and got[1].base_labels == "gpl"
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].labels) == (3, 3, 7, "mit")
    assert got[3].labels == "cc-by-nc-4.0" and got[3].base_labels == "" and got[3].score == 1.0
    assert got[4].labels == "gpl-3.0,gpl-3.0-or-later" and got[5].labels == "bsd-3-clause,mpl-2.0,proprietary"
    for i in (6, 7, 8):
        assert got[i].labels == "" and got[i].first_word is None and got[i].score == 0.0
    assert got[9].n_words == 4001 and (got[9].n_base, got[9].first_word) == (1, 3999)


def test_license_gate_loses_nothing_and_suppression_is_by_containment():
    rng = random.Random(4)
    rules = licenses.build_rules()
    assert len(rules) > 300
    bits = " ".join(LICENSED[:6]).split() + ["gpl", "v2", "or", "later", "lgpl", "2.1", "creative", "commons", "attribution", "4.0", "public", "domain", "x"]
    scanner = licenses.Scanner(rules)
    compiled = [(r, licenses.whole_words(r.pattern)) for r in rules]
    for _ in range(150):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        line = b" ".join(text.encode().translate(licenses.KEPT).split())
        found = [(m.start(), m.end(), r.priority, r.label, r.confidence) for r, p in compiled for m in p.finditer(line)]
        kept = licenses.suppressed(found)
        result = scanner.scan(text)
        assert {s["label"] for s in result["spans"]} == {x[3] for x in kept}
        for x in found:
            inside = [k for k in kept if k[0] <= x[0] and k[1] >= x[1] and k[2] <= x[2]]
            assert inside  # kept itself, or inside one that is at least as strong
        for x in kept:
            assert not [k for k in kept if k != x and k[0] <= x[0] and k[1] >= x[1] and k[2] <= x[2]]


def matching(tree, rng):
    """A text that a pattern matches, drawn at random."""
    out = ""
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "NOT_LITERAL":
            out += "w"
        elif kind == "IN":
            first = value[0]
            out += "w" if str(first[0]) == "NEGATE" else rng.choice([chr(rng.randint(*v)) if str(k) == "RANGE" else chr(v) for k, v in value])
        elif kind == "BRANCH":
            out += matching(rng.choice(value[1]), rng)
        elif kind == "SUBPATTERN":
            out += matching(value[3], rng)
        elif kind == "MAX_REPEAT":
            low, high, part = value
            out += "".join(matching(part, rng) for _ in range(rng.randint(low, min(high, low + 3))))
        else:
            raise AssertionError(kind)
    return out


def test_every_rule_is_reached_through_its_keywords():
    rng = random.Random(14)
    rules = licenses.build_rules()
    assert len(licenses.PLAIN) + len(licenses.WRITTEN) >= 240
    for rule in rules:
        tree, pattern = re._parser.parse(rule.pattern), licenses.whole_words(rule.pattern)
        for _ in range(12):
            text = matching(tree, rng)
            assert pattern.search(text.encode()) and any(k in text for k in rule.keywords), (rule, text)


def test_license_texts_are_known_by_their_clauses(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software ... subject to the following conditions",
        "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
        "gpl-2.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "zlib": "The origin of this software must not be misrepresented; Altered source versions must be plainly marked as such",
        "sspl-1.0": "Licensed under the Server Side Public License, v 1",
    }
    got = [r.labels for r in licenses.scan_licenses(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts.values())])).orderBy("doc_id").collect()]
    assert all(label in found.split(",") for label, found in zip(texts, got, strict=True)), got


def luhn_card(rng, n=16):
    digits = [rng.randint(0, 9) for _ in range(n - 1)]
    return next(s for d in range(10) if privacy.luhn(s := "".join(map(str, digits)) + str(d)))


def reference_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and privacy.luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for k in range(3000):
        text = "".join(rng.choice(["a", "B.", "@", "x.y", "1", "22", "255.", "300.", "+", " ", "-", "(", ")", "é", "\n", luhn_card(rng)]) for _ in range(rng.randint(0, 25)))
        assert privacy.base_spans(text) == reference_spans(text), (k, text)


def test_long_runs_take_linear_time():
    assert privacy.base_spans("1" * 200_000 + "a" * 200_000 + "@" + "1." * 50_000 + "0" * 6000 + ".1.1.1") is not None


def test_disclosing_terms_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = [rng.choice(PROSE.split()) for _ in range(30)]
        if i % 10 == 0:
            words[10:10] = ["Zanzibar", "bob@mail.example", "Smith"]
        if i % 25 == 1:
            words.append("Smith")
        if i % 50 == 2:
            words[3:3] = ["call", "+1 (555) 123-4567"]
        rows.append((i, " ".join(words), "en", "a"))
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "eve@mail.example alone", "en", "a"), (402, "eve@mail.example alone", "en", "a")]
    plan = privacy.Disclosure()
    got = defaultdict(list)
    for r in privacy.sanitation(documents(spark, rows), plan).collect():
        got[r.doc_id].append(r)
    terms = {}
    near, holders, df = defaultdict(set), defaultdict(set), Counter()
    for n, (_, text, _, _) in enumerate(rows):
        text = text or ""
        spans = reference_spans(text)
        free = [(m.start(), m.end()) for m in privacy.TERM.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        for w in {text[a:b].lower() for a, b in ((m.start(), m.end()) for m in privacy.TERM.finditer(text))}:
            df[w] += 1
        for kind, a, b in spans:
            entity = privacy.entity_of(kind, text[a:b])
            holders[entity].add(n)
            for p in free:
                near[(entity, text[p[0] : p[1]].lower())].add(n)
                terms.setdefault(n, []).append((entity, p))
    total = len(rows)

    def tie(entity, word):
        both, n, z = len(near[(entity, word)]), df[word], plan.doubt
        share = both / n
        least = (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if least < plan.certain or len(holders[entity]) == total:
            return 0
        return math.log2(total * least / len(holders[entity])) / math.log2(total / len(holders[entity]))

    flagged = 0
    for n, (i, text, _, _) in enumerate(rows):
        spans = reference_spans(text or "")
        ties = defaultdict(float)
        for entity, p in terms.get(n, []):
            ties[p] = max(ties[p], tie(entity, text[p[0] : p[1]].lower()))
        extra = sorted(("removed" if t >= plan.remove else "generalised", *p) for p, t in ties.items() if t >= plan.generalise)
        flagged += len(extra)
        expected = ",".join(f"{k}:{a}:{b}" for k, a, b in [*spans, *extra])
        assert any(r.spans == expected for r in got[i]), (i, expected, got[i])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i][0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert flagged >= 30  # Zanzibar discloses bob
    clean = {r.doc_id: r.text for r in privacy.sanitise(documents(spark, rows[:60] + rows[300:302]), plan).collect()}
    assert "bob@" not in clean[0] and "Zanzibar" not in clean[0] and "[email]" in clean[0] and clean[3] == rows[3][1] and clean[400] is None


def test_one_meeting_in_a_large_corpus_is_no_evidence(spark):
    """A word that stands in a few documents meets an entity once and stays; a name tied to one in several documents goes."""
    rng = random.Random(28)
    rows = [(i, " ".join(rng.choice(PROSE.split()) for _ in range(12)), "en", "a") for i in range(3000)]
    rows += [(4000 + i, "the rarely seen of and", "en", "a") for i in range(4)]
    rows += [(5000, "rarely to ann@mail.example in", "en", "a")]
    rows += [(6000 + i, f"Quixley and tom@mail.example {rng.choice(PROSE.split())}", "en", "a") for i in range(6)]
    got = {r.doc_id: r for r in privacy.sanitation(documents(spark, rows)).collect()}
    assert not [t for t in got[5000].terms or [] if rows[3004][1][t["start"] : t["end"]] == "rarely"]
    assert all((got[6000 + i].terms or [])[0]["start"] == 0 for i in range(6))
    assert got[0].kept_share == 1.0 and got[5000].kept_share == pytest.approx(1 - 16 / len(rows[3004][1]))
    assert 0 < got[6000].kept_share < 0.5


def test_sanitised_rows_keep_their_number_and_columns_may_clash(spark):
    rows = [(1, "mail bob@mail.example now", "x"), (1, "mail bob@mail.example now", "x"), (1, "nothing here", "y"), (None, "call +1 (555) 123-4567", "z"), (2, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("__spans", F.lit(1))
    out = privacy.sanitise(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, "@" in (r.text or "") or "555" in (r.text or ""), r.spans) for r in out.collect())
    assert got == Counter([(1, False, "x"), (1, False, "x"), (1, False, "y"), (None, False, "z"), (2, False, "w")])


def test_terms_of_entities_in_one_document_are_marked(spark):
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choice(PROSE.split()) for _ in range(30)), "en", "a") for i in range(200)]
    rows += [(200 + i, f"the Name{'abcdefgh'[i]}x and user{i}@mail.example of the", "en", "a") for i in range(8)]
    rows += [(300, "the Twicely and twin@mail.example", "en", "a"), (301, "the Twicely and twin@mail.example", "en", "a")]
    got = {r.doc_id: r.spans for r in privacy.sanitation(documents(spark, rows)).collect()}
    for i, text, _, _ in rows[200:]:
        kinds = [s for s in got[i].split(",") if s.split(":")[0] in ("removed", "generalised")]
        at = 4
        name = re.match("[A-Za-z]+", text[at:])[0]
        # One document tells less than two.
        assert kinds == ["%s:%d:%d" % ("generalised" if i < 300 else "removed", at, at + len(name))], (i, got[i])
    assert not any(got[i] for i in range(200))


def test_disclosing_terms_are_marked_far_from_the_entity(spark):
    rng = random.Random(19)
    prose = lambda n: " ".join(rng.choice(PROSE.split()) for _ in range(n))
    rows = [(i, prose(200), "en", "a") for i in range(200)]
    rows += [(200 + i, f"Zanzibar {prose(100)} bob@mail.example +1 (555) 123-4567 {prose(100)} zanzibar", "en", "a") for i in range(5)]
    got = {r.doc_id: r.spans for r in privacy.sanitation(documents(spark, rows)).collect()}
    for i, text, _, _ in rows[200:]:
        assert got[i].endswith(f",removed:0:8,removed:{len(text) - 8}:{len(text)}"), got[i]
    assert not any(got[i] for i in range(200))
