"""Operators on pairs, archives and the pipeline, against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import random
import re
import struct
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from siftwell.llm import hashing, line_dedup, ngram_join, setjoin, vectors, warc
from siftwell.llm.components import components
from test_counts import documents


def grouped(n, links):
    """The smallest member of each member's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 300)] + [(900, 500 + i) for i in range(100)]
    wild = [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)] + [(7, 7), (1, 0)]
    for edges in (path, star, wild, path + star + wild, [], [(3, 3)]):
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        expected = grouped(1201, edges)
        assert got == {i: c for i, c in enumerate(expected) if c != i}


def test_word_hashes_are_those_of_the_words():
    texts = ["A b  c", None, "", "\x0bü Ü x y\x1f z", "a" * 70_000 + " " + "b" * 10, "tail\n"]
    data, offsets = hashing.text_bytes(pa.array(texts))
    hashes, rows, _ = hashing.words(data, offsets)
    alone = {}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert rows[i + 1] - rows[i] == len(words)
        for w, h in zip(words, hashes[rows[i] : rows[i + 1]].tolist(), strict=True):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            assert alone.setdefault(w, h) == h
    assert len(set(alone.values())) == len(alone)
    first = hashing.shingles(hashes[:3], 4)
    assert len(first) == 1 and first[0] not in hashing.shingles(hashes[:3], 3)[:0]


def shingle_set(text, width):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def linked_sets(sets, percent):
    links = []
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                links.append((j, i))
    return links


def near_texts(rng):
    """Groups of near copies, of exact copies, a passage that many share, and texts made of passages only."""
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    other = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 120]))]
        for _ in range(rng.choice([2, 5, 25])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join([rng.choice(vocabulary) for _ in range(30)] + passage) for _ in range(30)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 8))]) for _ in range(25)]
    texts += [" ".join(other[: rng.randint(40, 60)]) for _ in range(20)]
    texts += ["one Two three", "One two THREE", "one two", "", None, " \n ", "single", "single", "x" * 40_000 + " y z q r"]
    rng.shuffle(texts)
    return texts


TINY = {"short_run": 2, "frequent": 4, "piece_tokens": 3000, "piece_pairs": 60, "copies": 2, "salted": 40}


@pytest.mark.parametrize("small", [False, True])
def test_similar_documents(spark, small):
    texts = near_texts(random.Random(11))
    rows = [(i * 3, t, "en", "a") for i, t in enumerate(texts)]
    plan = setjoin.Join(85, **TINY) if small else None
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(spark, rows).repartition(5), 4, 85, plan).collect()}
    sets = [shingle_set(t, 4) for t in texts]
    expected = grouped(len(texts), linked_sets(sets, 85))
    assert got == {i * 3: (len(sets[i]), expected[i] * 3) for i in range(len(texts))}


@pytest.mark.parametrize("variants", [20, 30])
def test_variants_with_tokens_behind_the_keys_link(spark, variants):
    """Tokens too rare to stand late may be keys of the original and lie behind the keys of its longer variants."""
    texts = []
    for group in range(6):
        words = [f"common{i}" for i in range(80)] + [f"own{group}x{i}" for i in range(20)]
        texts += [" ".join(words)] + [" ".join([*words, *[f"new{group}x{v}x{i}" for i in range(10)]]) for v in range(variants)]
    sets = [shingle_set(t, 1) for t in texts]
    links = linked_sets(sets, 85)
    assert len(links) == 6 * variants
    expected = grouped(len(texts), links)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), 1, 85).collect()}
    assert got == dict(enumerate(expected))


def test_similar_documents_without_ids_and_with_repeated_rows(spark):
    rows = [(None, "a b c d e", "en", "a"), (5, "a b c d e", "en", "a"), (5, "a b c d e", "en", "a"), (2, "A B C D E", "en", "a"), (None, None, "en", "a"), (9, None, "en", "a")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(spark, rows), 4, 85).collect())
    assert got == Counter([(None, 2, None), (5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 0, None), (9, 0, 9)])
    assert ngram_join.similar_documents(documents(spark, []), 4, 85).count() == 0
    docs = documents(spark, rows)
    kept = ngram_join.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 9), (True, 0), (True, 0)]


def gram_set(line, width):
    return {line[i : i + width] for i in range(len(line) - width + 1)}


def test_repeated_lines(spark):
    rng = random.Random(21)
    alphabet = "abcdefghij klmnop"
    seeds = ["".join(rng.choice(alphabet) for _ in range(rng.choice([30, 80, 200]))) for _ in range(12)]
    common = "this very common line stands in most of the documents"

    def near(line):
        line = list(line)
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            line[rng.randrange(len(line))] = rng.choice(alphabet)
        return "".join(line)

    texts = []
    for _ in range(70):
        lines = [near(rng.choice(seeds)) for _ in range(rng.randint(0, 4))] + ["".join(rng.choice(alphabet) for _ in range(60))]
        lines += rng.choice([[common], [common.upper(), "  " + common.replace(" ", "\t") + " "], [], ["short", "short"], [""]])
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [None, "", common, common]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, common, "en", "a")]
    plan = line_dedup.Lines(bands=24)
    items = []
    for i, t in enumerate(texts):
        for n, raw in enumerate((t or "").split("\n")):
            line = " ".join(raw.lower().split())
            if len(line) >= plan.min_chars:
                items.append((i, n, gram_set(line, plan.width)))
    first = grouped(len(items), linked_sets([s for _, _, s in items], plan.percent))
    expected = defaultdict(list)
    for k, (i, n, _) in enumerate(items):
        if first[k] != k:
            expected[i].append(n)
    docs = documents(spark, rows)
    assert {r.doc_id: r.removed for r in line_dedup.repeated_lines(docs, plan).collect()} == dict(expected)
    out = line_dedup.dedup_lines(docs, plan)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    for i, t in enumerate(texts):
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in expected[i])
        gone = bool(expected[i]) and not left.split()
        assert (i not in got) if gone else got[i][0] == left and got[i][1] == len(left or "")
    assert got[None][0] == common and line_dedup.dedup_lines(documents(spark, [])).count() == 0
    report = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_report(docs, plan).filter("doc_id is not null").collect()}
    assert report == {i: (0 if t is None else len(t.split("\n")), len(expected[i])) for i, t in enumerate(texts)}


def test_short_lines_are_compared(spark):
    near = "a line of 19 chars"
    texts = ["}\nYes.\n\nown line\nseven77\n" + near, "yes.\n\n }  \nother\nseven78\n" + near + "s", "\n  \n第一章\nYes", "第一章\nYES.\nseven77", None, ""]
    report = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.line_report(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert report == {0: (6, ""), 1: (6, "0,2,5"), 2: (4, ""), 3: (3, "0,1,2"), 4: (0, ""), 5: (1, "")}
    items = [x for t in texts if t for raw in t.split("\n") if (x := " ".join(raw.lower().split()))]
    block = line_dedup.LineItems(line_dedup.EVERY).block(np.arange(len(items)), np.arange(len(items)), items)
    assert len(set(block.nodes().tolist())) == len(set(items))


def vector_rows(rng):
    rows, at = [], 0
    for label in (1, 2, None, 3):
        for _ in range(6):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 12)):
                rows.append((at, label, (centre * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.2])).tolist()))
                at += 1
    extra = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-200] * 16, [1e200] * 16, [3.0] * 16]
    return rows + [(at + i, 1, v) for i, v in enumerate(extra)]


@pytest.mark.parametrize("tile", [5, 1000])
def test_near_vectors(spark, tile):
    rows = vector_rows(np.random.default_rng(4))
    df = spark.createDataFrame([(i, label, v, 1, "x") for i, label, v in rows], "vec_id long, label int, embedding array<double>, rid int, tile string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, vectors.Tiling(tile=tile)).collect()}

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v) / np.abs(v).max()
        return a / np.linalg.norm(a)

    units = [unit(v) for _, _, v in rows]
    links = [
        (j, i)
        for i in range(len(rows))
        for j in range(i)
        if rows[i][1] is not None and rows[i][1] == rows[j][1] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98
    ]
    n = Counter(x for p in links for x in p)
    first = grouped(len(rows), links)
    assert len(links) > 50 and got == {i: (n[i], first[i], first[i] == i) for i in range(len(rows))}


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(9)
    for dim in (3, 64, 1500):
        a, b = rng.normal(size=(60, dim)), rng.normal(size=(60, dim))
        a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
        (qa, sa, na, ea), (qb, sb, nb, eb) = vectors.quantised(a), vectors.quantised(b)
        exact = vectors.products(qa, qb)
        assert (exact == qa.astype(np.int64) @ qb.astype(np.int64).T).all()
        bound = na[:, None] * eb + ea[:, None] * nb + ea[:, None] * eb
        assert (np.abs(a @ b.T - exact * sa[:, None] * sb) <= bound + 1e-12).all()


def test_vectors_without_an_id_and_repeated_ones(spark):
    df = spark.createDataFrame([(None, 1, [1.0, 0.0]), (4, 1, [1.0, 0.0]), (4, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0])], "vec_id long, label int, embedding array<float>")
    got = Counter(tuple(r) for r in vectors.near_vectors(df).collect())
    assert got == Counter([(None, 0, None, True), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True)])
    assert vectors.near_vectors(df.limit(0)).count() == 0


def expected_records(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None and (html or "") not in first or i is not None and i < first[html or ""]:
            first[html or ""] = i
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        shared = sum((h or "") == (html or "") for _, _, h in rows) > 1 and len(data) >= least
        refers = first.get(html or "") if shared and first.get(html or "") != i else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return Counter(out)


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}?q=ü\r\nEvil: 1", rng.choice(["<p>one</p>", "<p>two</p>\r\n\r\nbody", "é" * rng.randint(0, 9), "z" * 50_000, None, ""])) for i in range(200)]
    rows += [(None, None, "<p>one</p>"), (None, "u", "only here"), (3, "again", rows[3][2])]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, first int").repartition(3)
    for least, target in ((0, 1 << 28), (4, 300)):
        folder = f"file://{tmp_path}/{target}"
        manifest = warc.write_archives(pages, folder, target_bytes=target, min_revisit_bytes=least)
        back = warc.read_archives(manifest, folder, range_bytes=500).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == expected_records(rows, least)
        for path in (tmp_path / str(target)).glob("*.wacz"):
            with zipfile.ZipFile(path) as z:  # any reader of the format opens them
                assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_foreign_archives_are_read(spark, tmp_path):
    """Two WARC files, one of them unpacked, a packed index and a plain one in URL order, with strings for numbers and a header line."""
    def warc_record(kind, name, body, extra=""):
        head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: http://h/{name}\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    page = lambda text: b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + text
    digest = base64.b32encode(hashlib.sha1(b"two").digest()).decode()
    records = {
        "a.warc.gz": [warc_record("warcinfo", "i", b"software: x"), warc_record("response", "1", page(b"one")), warc_record("response", "2", page(b"two"), f"WARC-Payload-Digest: sha1:{digest}\r\n")],
        "b.warc": [warc_record("revisit", "3", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n", f"WARC-Payload-Digest: sha1:{digest}\r\nWARC-Refers-To: <urn:uuid:2>\r\n"), warc_record("request", "4", b"GET / HTTP/1.1\r\n\r\n")],
    }
    lines = {name: [] for name in records}
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as z:
        for name, own in records.items():
            at, out = 0, b""
            for i, raw in enumerate(own):
                piece = gzip.compress(raw) if name.endswith(".gz") else raw
                lines[name].append(f'com,h)/{9 - i} 20240101000000 {json.dumps({"url": "u", "offset": str(at), "length": str(len(piece)), "filename": name})}')
                at, out = at + len(piece), out + piece
            z.writestr(f"archive/{name}", out)
        z.writestr("datapackage.json", "{}")
        z.writestr("indexes/one.cdxj.gz", gzip.compress("\n".join(["!meta {}", *sorted(lines["a.warc.gz"])]).encode()))
        z.writestr("indexes/two.cdxj", "\n".join(sorted(lines["b.warc"])) + "\n")
    manifest = spark.createDataFrame([(str(tmp_path / "x.wacz"),)], "path string")
    for size in (1, 1 << 22):
        got = sorted((r.record_id, r.record_type, r.payload_bytes, r.payload_digest if r.record_type == "revisit" else None, r.refers_id, r.page_id) for r in warc.read_archives(manifest, f"file://{tmp_path}", size).collect())
        name = lambda x: f"<urn:uuid:{x}>"
        assert got == [(name("1"), "response", 3, None, None, None), (name("2"), "response", 3, None, None, None), (name("3"), "revisit", 3, digest, name("2"), None), (name("4"), "request", 18, None, None, None), (name("i"), "warcinfo", 11, None, None, None)]


def test_members_of_foreign_zip_files():
    for comment, wide in ((b"", False), (b"PK\x05\x06 no end" * 3, False), (b"c", True)):
        out = io.BytesIO(b"")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.comment = comment
            for i in range(5):
                with z.open(f"dir/m{i}", "w", force_zip64=wide) as f:
                    f.write(b"x" * i + b"end")
            z.writestr(zipfile.ZipInfo("packed"), b"a" * 100, zipfile.ZIP_DEFLATED)
        found = {m.name: m for m in warc.members(out)}
        data = out.getvalue()
        assert all(data[found[f"dir/m{i}"].start :][: found[f"dir/m{i}"].size] == b"x" * i + b"end" and found[f"dir/m{i}"].stored for i in range(5))
        assert not found["packed"].stored


def test_zip64_directory():
    """An archive whose numbers all stand in ZIP64 records, as in one beyond 4 GB."""
    body, name = b"payload", b"archive/data.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHH", 0x9999, 2, 0) + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 4)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = 4 + len(local)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = io.BytesIO(b"junk" + local + entry + end64 + locator + end)
    (member,) = warc.members(file)
    assert member.stored and file.getvalue()[member.start : member.start + member.size] == body


def test_pipeline_stages_hand_on_documents(spark):
    rng = random.Random(31)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "ti", "su", "no", "ve") for c in ("n", "st", "l", "m", "rk")]

    def text(n):
        return "\n".join(" ".join(rng.choice(["the", "of", "and", "to", *rng.sample(vocabulary, 3)]) for _ in range(20)) for _ in range(n))

    rows = [(i, text(6), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)]  # exact copies
    rows += [(200 + i, "too short", "en", "s1") for i in range(5)] + [(300, None, None, None), (301, "", "en", None)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality rules":
            assert ids == {*range(60), *range(100, 110)}
        if name in ("line dedup", "n-gram jaccard join"):
            assert ids == set(range(60))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    words = Counter()
    for r in packed:
        words[r.doc_id] += r.n_words
    expected = Counter()
    for r in docs.collect():
        expected[r.doc_id] += len(r.text.split())
    assert words == expected
