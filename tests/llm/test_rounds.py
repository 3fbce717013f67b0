"""Centroid clustering, benchmark decontamination and the filter audit, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from siftwell.llm import audit, centroids, decontaminate
from test_counts import documents

# ---- centroid clustering -----------------------------------------------------------------------------


def test_the_transform_keeps_distances_and_is_undone():
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 2000, (40, 64))
    y = centroids.transformed(x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert (((y[:, None] - y[None]) ** 2).sum(axis=2) == 64 * d).all()
    assert [centroids.restored(r) for r in y.tolist()] == x.tolist()
    # Coarse to fine: the first coefficient is the sum, and each further row of the matrix changes its sign once more.
    assert (y[:, 0] == x.sum(axis=1)).all()
    rows = centroids.transformed(np.eye(64, dtype=np.int64)).T
    assert (np.abs(np.diff(rows, axis=1)) > 0).sum(axis=1).tolist() == list(range(64))


@pytest.mark.parametrize("spread", [3, 400, centroids.LIMIT - 1])
def test_search_equals_all_distances_and_ties_go_to_the_smaller_number(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (500, 64))
    c = np.concatenate([x[:6], x[2:4]])  # two centroids stand twice
    best, d = centroids.nearest(centroids.transformed(x), centroids.transformed(c))
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (d == 64 * full.min(axis=1)).all()


def by_hand(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 16384 for x in v)]
    points = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        for c, vs in groups.items():
            points[c] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    found = [(i, *place(v)) for i, v in kept]
    sums = Counter()
    for _, d, c in found:
        sums[c] += d
    return sorted((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in found)


VECTORS = "vec_id long, embedding array<float>, label int, cluster int, c string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "x") for i, v in rows], VECTORS)


def single(rng, n=64):
    return [float(np.float32(rng.gauss(0, 1))) for _ in range(n)]


def test_clusters_equal_a_plain_k_means(spark):
    rng = random.Random(5)
    centres = [single(rng) for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.4))) for x in rng.choice(centres)]) for i in range(90)]
    rows += [(200, None), (201, []), (202, single(rng, 63)), (203, [None, *single(rng, 63)]), (204, [math.nan, *single(rng, 63)]), (205, [math.inf, *single(rng, 63)])]
    rows += [(206, [0.0] * 64), (207, [20000.0, *single(rng, 63)]), (90, rows[0][1]), (91, rows[0][1]), (91, rows[0][1])]
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = centroids.cluster(vectors(spark, rows))
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows)


def test_few_vectors_none_and_those_without_an_id(spark):
    rng = random.Random(2)
    assert centroids.cluster(vectors(spark, [])).count() == 0
    assert centroids.cluster(vectors(spark, [(1, None)])).count() == 0
    three = [(i, single(rng)) for i in range(3)]
    assert [(r.vec_id, r.distance) for r in centroids.cluster(vectors(spark, three)).orderBy("vec_id").collect()] == [(0, 0), (1, 0), (2, 0)]
    same = [(i, [1.5] * 64) for i in range(20)]
    assert {(r.cluster, r.distance) for r in centroids.cluster(vectors(spark, same)).collect()} == {(0, 0)}
    unnamed = [(None, single(rng)) for _ in range(4)] + [(i, single(rng)) for i in range(8)]
    assert centroids.cluster(vectors(spark, unnamed)).filter("vec_id is null").count() == 4


# ---- winnowing ---------------------------------------------------------------------------------------


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hits_by_hand(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        ws = words_of(text)
        m = min(10, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            windows[tuple(ws[i : i + m])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        ws = words_of(text)
        hit, found = set(), set()
        for m in {len(w) for w in windows}:
            for i in range(len(ws) - m + 1):
                if items_of := windows.get(tuple(ws[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= items_of
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, key string")


def told(spark, docs, items, **plan):
    got = decontaminate.decontaminate(documents(spark, [(i, t, "en", "a") for i, t in docs]), benchmark(spark, items), decontaminate.Winnowing(**plan))
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)


def test_winnowing_equals_all_windows(spark):
    rng = random.Random(11)
    few = [f"w{i}" for i in range(6)]  # so few words that windows repeat by chance, with equal fingerprints
    prose = [f"Wörd{i}" for i in range(300)]
    sep = [" ", " ", ", ", "\n", " - ", "_", "\t"]

    def text(pool, n):
        return "".join(rng.choice(pool) + rng.choice(sep) for _ in range(n))

    items = [(i, text(prose, rng.choice([10, 11, 25, 40]))) for i in range(12)]
    items += [(20, "w1 w2 w3"), (21, "w4"), (22, "w1 w1 w2 w5 w0 w3"), (23, text(few, 12)), (24, ""), (25, None), (26, "... !"), (None, text(prose, 30)), (27, items[0][1]), (2, text(prose, 15)), (28, text(few, 9))]
    docs = [(i, text(prose, rng.choice([5, 30, 200]))) for i in range(20)]
    for i in range(20, 60):
        own = words_of(rng.choice([t for _, t in items if words_of(t)]))
        a = rng.randrange(max(1, len(own) - 3))
        part = own[a : a + rng.choice([4, 9, 10, 11, 30])]
        docs.append((i, text(prose, rng.choice([0, 3, 50])) + "".join(c.upper() if c < "\x80" else c for c in " ".join(part)) + " " + text(rng.choice([few, prose]), rng.choice([0, 2, 60]))))
    docs += [(70, None), (71, ""), (72, "!!"), (None, items[0][1]), (73, items[0][1]), (73, items[0][1]), (73, "other"), (74, text(few, 4000)), (75, (items[1][1] + " x ") * 40)]
    expected = hits_by_hand(docs, items)
    assert sum(r[5] for r in expected) > 20
    assert told(spark, docs, items) == expected
    # With a table of bits that is far too small most windows pass it by mistake; the join keeps the result right.
    assert told(spark, docs, items, least_bits=1 << 12, most_bits=1 << 12, bits_each=1) == expected
    assert told(spark, docs, items, gram=3) == expected


def test_every_shared_span_has_a_common_fingerprint():
    rng = np.random.default_rng(3)
    for _ in range(200):
        span = rng.integers(0, 2**63, 10).astype(np.uint64)
        marks = []
        for _ in range(2):
            text = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64), span, rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])
            _, at, grams = decontaminate.winnowed(text, np.array([0, len(text)]), 10, 5)
            marks.append(set(grams[at].tolist()))
        assert marks[0] & marks[1]


def test_no_benchmark_and_no_documents(spark):
    docs = [(1, "a b c"), (2, None)]
    for items in ([], [(1, None)], [(1, "?")]):
        assert told(spark, docs, items) == hits_by_hand(docs, items)
    assert told(spark, [], [(1, "a b c")]) == []


def test_spans_and_clean_documents(spark):
    item = " ".join(f"t{i}" for i in range(12))
    docs = documents(spark, [(1, f"one two {item} three {item}", "en", "a"), (2, "clean", "en", "a"), (None, item, "en", "a")])
    found = decontaminate.decontaminate(docs, benchmark(spark, [(5, item)]))
    assert {r.doc_id: r.spans for r in found.collect()} == {1: "2:14,15:27", 2: "", None: "0:12"}
    kept = decontaminate.clean_documents(docs, benchmark(spark, [(5, item)]))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}


# ---- filter audit ------------------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, source in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", [len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]], strict=True) if bad}
        parts[source or ""].append((i, fails))
    out = []
    for part, docs in parts.items():
        rows_of, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in docs) - len(gone)
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                rows_of.append((part, order, step, len(left), len(gone), redundant, sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows_of]
    return sorted(out)


def test_lehmer_ranks():
    for rank, p in enumerate(permutations(range(5))):
        assert audit.lehmer_rank(p) == rank
    assert audit.lehmer_rank((2,)) == 48 and audit.lehmer_rank((2, 4)) == 48 + 18


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        steps = np.zeros((6, 121), int)
        for m, step, rank, sign in audit.removals():
            if m == mask:
                steps[step, rank] += sign
        assert (steps.cumsum(axis=1)[:, :120].sum(axis=0) == 1).all()


def test_audit_equals_all_orders(spark):
    rng = random.Random(8)

    def text():
        n, pool = rng.choice([10, 49, 50, 80]), rng.choice([20, 400])
        return " ".join(rng.choice(["", "", "", "Q"]) + f"w{rng.randrange(pool)}" + rng.choice([""] * 40 + ["#", "|"]) for _ in range(n))

    rows = [(i, text(), rng.choice(["a", "b", "", None])) for i in range(60)]
    rows += [(100 + i, rng.choice(rows)[1], rng.choice(["a", "c"])) for i in range(30)]
    rows += [(200, None, "a"), (201, "", "b"), (None, rows[0][1], "a"), (None, None, "n"), (5, rows[5][1], "a"), (5, "other", "a"), (202, "word " * 20000, "a"), (202, "word " * 20000, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1), (202, 0, 1)]
    docs = documents(spark, [(i, t, "en", s) for i, t, s in rows])
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, mask string")
    got = audit.audit(docs, table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    expected = audit_by_hand([r for r in rows], [r for r in labels if r[0] is not None])
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert audit.audit(documents(spark, []), table).count() == 0
    assert audit.audit(docs, table.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
