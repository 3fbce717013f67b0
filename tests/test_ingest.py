"""Splitting, validation, dedup, catalog, sources and tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from siftwell.operators import embed as em
from siftwell.operators import ingest as ig
from siftwell.sources import files as fs
from siftwell.sources import ranges as rg
from siftwell.sources import tables as tb


def sample(seed: int) -> str:
    r = random.Random(seed)
    out = []
    for _ in range(r.randrange(1, 12)):
        out.append(" ".join("".join(r.choice("abcé") for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(1, 40))))
    return r.choice(["\n", "\n\n"]).join(out)


@pytest.mark.parametrize("size,overlap", [(40, 10), (100, 0), (25, 24)])
def test_recursive_split_keeps_bounds_and_words(size, overlap):
    for seed in range(30):
        text = sample(seed)
        pieces = ig.split_recursive(text, size, overlap)
        assert all(0 < len(p) <= size and p == p.strip() for p in pieces)
        at = 0
        for p in pieces:
            found = text.find(p, max(0, at - size))
            assert found >= 0
            at = found + len(p)
        assert set("".join(pieces)) | set(" \n") >= set(text)


def test_recursive_split_small_examples():
    assert ig.split_recursive("aa bb cc", 5, 0) == ["aa bb", "cc"]
    assert ig.split_recursive("aa bb cc", 6, 3) == ["aa bb", "bb cc"]
    assert ig.split_recursive("aa bb cc", 5, 3) == ["aa bb", "cc"]
    assert ig.split_recursive("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]
    assert ig.split_recursive("p one\n\np two", 6, 0) == ["p one", "p two"]
    assert ig.split_recursive("", 5, 1) == []


def test_recursive_chunks_copy_columns(spark):
    df = ig.chunk_recursive(spark.createDataFrame([(1, "aa bb cc", "s")], "id long, text string, source string"), 5, 0)
    assert [(r["id"], r["ix"], r["text"], r["source"]) for r in df.orderBy("ix").collect()] == [(1, 0, "aa bb", "s"), (1, 1, "cc", "s")]


def test_fixed_chunks_equal_slicing_also_across_blocks(spark):
    texts = ["", "short", "é" * 17, "".join(chr(97 + i % 26) for i in range(5000))]
    df = ig.chunk_fixed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 20, 5)
    got: dict = {}
    for r in df.orderBy("id", "ix").collect():
        got.setdefault(r["id"], []).append((r["ix"], r["text"]))
    for i, text in enumerate(texts):
        starts = [s for s in range(0, len(text) or 1, 15) if s == 0 or s + 5 < len(text)]
        assert got[i] == [(n, text[s : s + 20]) for n, s in enumerate(starts)]


def test_validation_and_defaults(spark):
    rows = [("hello world", None), ("", "a.pdf"), (None, None), ("x", "b.pdf")]
    valid, invalid = ig.validate_ingest(spark.createDataFrame(rows, "text string, source string"))
    got = {r["text"]: r for r in valid.collect()}
    assert set(got) == {"hello world", "x"}
    first = got["hello world"]
    assert first["id"] == hashlib.sha1(b"hello world").hexdigest() and len(first["id"]) == 40
    assert (first["source"], first["page"], first["doc_type"], first["date"]) == ("", -1, "", "")
    assert [r["reason"] for r in invalid.collect()] == ["empty_text"] * 2


def test_given_ids_have_bounded_length_and_stay_distinct_and_texts_stay_whole(spark):
    df = spark.createDataFrame([("my-id", "x" * 70000), ("my-id" * 20 + "a", "y"), ("my-id" * 20 + "b", "z")], "id string, text string")
    valid, _ = ig.validate_ingest(df)
    rows = ig.normalise_rows(valid, id_chars=40).collect()
    assert {r["id"] for r in rows} == {"my-id", *(hashlib.sha256(("my-id" * 20 + c).encode()).hexdigest()[:40] for c in "ab")}
    assert max(len(r["text"]) for r in rows) == 70000


def test_embedding_model_map(spark):
    df = spark.createDataFrame([("pdf",), ("HTML",), ("odt",), (None,)], "doc_type string")
    pick = lambda spec: [r["embed_model"] for r in ig.select_embed_model(df, spec).collect()]
    assert pick("pdf:small, html:Small, default:large") == ["small", "small", "large", "large"]
    assert pick("") == ["large"] * 4
    assert pick("default:small,pdf:large") == ["large", "small", "small", "small"]


@pytest.mark.parametrize("unique", [True, False])
def test_dedup_is_idempotent(spark, unique):
    rows = [(i, f"k{i % 7}", f"t{i}") for i in range(60)] + [(100 + i, "hot", "copy") for i in range(50)]
    df = spark.createDataFrame(rows, "row long, id string, text string")
    seen = spark.createDataFrame([("k1",), ("k1",)], "id string")
    out = ig.dedup_new(df, seen, "row", unique=unique)
    got = {(r["id"], r["row"], r["text"]) for r in out.collect()}
    assert got == {(f"k{i}", i, f"t{i}") for i in range(7) if i != 1} | {("hot", 100, "copy")}
    assert ig.dedup_new(df, out.select("id").union(seen), "row", unique=unique).count() == 0


def test_catalog_ignores_empty_values(spark):
    rows = [("a", "s2", "pdf", "2024-05-01T01"), ("a", "s1", "", "2023-01-01"), ("a", "s1", None, None), ("b", "", "", "")]
    got = sorted(tuple(r) for r in ig.filter_catalog(spark.createDataFrame(rows, "tenant string, source string, doc_type string, date string")).collect())
    assert got == [("a", "date_max", "2024-05-01"), ("a", "date_min", "2023-01-01"), ("a", "doc_type", "pdf"), ("a", "source", "s1"), ("a", "source", "s2")]


def test_file_scan_and_document_loading(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PDF").write_bytes(b"%PDF one")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF two")
    (tmp_path / "sub" / "c.html").write_text("<p>Hi&amp;bye</p><script>x()</script>")
    (tmp_path / "d.txt").write_text("plain")
    (tmp_path / "e.bin").write_bytes(b"\xff\xfe")
    assert {r["source"] for r in fs.scan_files(spark, str(tmp_path)).collect()} == {"a.PDF", "b.pdf"}
    plain = {r["source"]: r for r in fs.load_documents(spark, str(tmp_path)).collect()}
    assert {k: (v["doc_type"], v["text"]) for k, v in plain.items()} == {"c.html": ("html", "Hi&bye"), "d.txt": ("txt", "plain")}
    assert plain["d.txt"]["date"] == dt.datetime.utcfromtimestamp((tmp_path / "d.txt").stat().st_mtime).date().isoformat()

    def pdf(data: bytes) -> list:
        if b"two" in data:
            raise ValueError("broken")
        return ["page one", "page two"]

    more = {(r["source"], r["page"]) for r in fs.load_documents(spark, str(tmp_path), {"pdf": pdf}).collect()}
    assert more == {("c.html", -1), ("d.txt", -1), ("a.PDF", 0), ("a.PDF", 1)}


def test_golden_reader_skips_what_it_cannot_use(spark, tmp_path):
    lines = ['{"query": "Define lift ratio", "expected_sources": ["handbook.pdf"], "keywords": ["lift", "ratio"]}', "", "{broken", '{"question": " Q2 "}', '{"query": ""}']
    (tmp_path / "golden.jsonl").write_text("\n".join(lines))
    rows = fs.read_golden(spark, str(tmp_path / "golden.jsonl")).collect()
    assert sorted(r["query"] for r in rows) == ["Define lift ratio", "Q2"]
    assert [r["keywords"] for r in rows if r["query"].startswith("Define")] == [["lift", "ratio"]]
    assert fs.read_golden(spark, str(tmp_path / "golden.jsonl"), 1).count() == 1
    digest = hashlib.sha1((tmp_path / "golden.jsonl").read_bytes()).hexdigest()
    assert fs.golden_hash(spark, str(tmp_path / "golden.jsonl")).first()["golden_hash"] == digest


def test_dual_write_survives_a_failing_secondary(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, tenant string")
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    error = tb.dual_write(df, str(tmp_path / "p"), str(blocked / "sub"), str(tmp_path / "log"))
    assert error and spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert {r["role"] for r in tb.successful_writes(spark, str(tmp_path / "log")).collect()} == {"primary"}


def test_tenant_folders_are_pruned_and_restore_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 3}", f"x{i}") for i in range(30)], "id long, tenant string, text string")
    tb.write_index(df, str(tmp_path / "index"))
    scan = tb.scan_index(spark, str(tmp_path / "index"), ["id", "tenant"]).filter("tenant = 't1'")
    assert "PartitionFilters: [isnotnull(tenant" in scan._jdf.queryExecution().executedPlan().toString() and scan.count() == 10
    back = spark.read.parquet(tb.backup_index(df, str(tmp_path / "backup"), "2024-01-01"))
    assert tuple(tb.validate_restore(df, back).first()) == (0, 0)
    damaged = back.filter("id <> 3").union(back.filter("id = 4"))
    assert tuple(tb.validate_restore(df, damaged).first()) == (1, 1)
    assert tb.table_checksum(df, "id").first()["checksum"] == tb.table_checksum(back, "id").first()["checksum"]


def test_promotion_needs_a_passed_gate_or_force(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "pointer")
    tb.init_pointer(spark, path, "v1")
    assert tb.promote(spark, path, True, at)["reason"] == "no_canary"
    tb.begin_canary(spark, path, "v2", at)
    assert tb.promote(spark, path, False, at)["promoted"] is False
    done = tb.promote(spark, path, False, at, force=True)
    assert done["promoted"] and done["pointer"]["active"] == "v2" and done["pointer"]["previous"] == "v1"
    with pytest.raises(ValueError):
        tb.failover(spark, path, "moon")
    assert tb.failover(spark, path, "Secondary")["read_preferred"] == "secondary"
    assert tb.read_pointer(spark, path)["active"] == "v2"


def test_json_lines_sink(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-02", None, 2)], "day string, tenant string, n long")
    tb.write_lines(df, str(tmp_path / "report"), "day")
    back = spark.read.json(str(tmp_path / "report"))
    assert {(str(r["day"]), r["tenant"], r["n"]) for r in back.collect()} == {("2024-01-01", "a", 1), ("2024-01-02", None, 2)}
    tb.write_lines(df.selectExpr("to_json(struct(*)) as summary"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_damaged_ranges_are_found_from_the_root_down_and_repaired(spark):
    rows = [(i, f"text {i}", None if i % 5 else "x") for i in range(2000)] + [(3, "text 3", None), (None, "no key", None), (None, "no key", None)]
    df = spark.createDataFrame(rows, "id long, text string, tag string")
    assert tb.damaged_leaves(df, df.repartition(3), "id", 200).count() == 0
    bad = [r for r in rows if r[0] not in (7, 900)] + [(5, "other", "x"), (11, "text 11", None), (9999, "extra", None)]
    bad = [r for r in bad if r != (5, "text 5", "x")]
    damaged = spark.createDataFrame(bad, "id long, text string, tag string")
    assert tuple(tb.validate_restore(df, damaged, "id", 200).first()) == (3, 3)
    leaves = {r[0] for r in tb.damaged_leaves(df, damaged, "id", 200).collect()}
    expected = {r[0] for r in spark.createDataFrame([(i,) for i in (7, 900, 5, 11, 9999)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(200))).collect()}
    assert leaves == expected
    mended = tb.repair_restore(df, damaged, "id", 200)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, mended.collect()), key=key) == sorted(rows, key=key)
    empty = df.limit(0)
    assert tuple(tb.validate_restore(empty, empty, "id").first()) == (0, 0)
    assert tuple(tb.validate_restore(empty, df, "id").first()) == (0, len(rows))
    assert tb.repair_restore(df, empty, "id").count() == len(rows)


def test_bulk_embedding_sets_failing_texts_apart(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(6)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in em.embed(df, model, pause=0.0, apart=True).collect()}
    assert got == {i: None if i == 3 else [float(i)] for i in range(6)}


def test_files_beyond_two_gigabytes_are_hashed_by_ranges(spark, tmp_path):
    size = (2 << 30) + 12345
    with open(tmp_path / "big.BIN", "wb") as f:  # mostly a hole, so it takes no room
        f.write(b"head")
        f.truncate(size)
        f.seek(size - 4)
        f.write(b"tail")
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "none.bin").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    got = {r["source"]: (r["size"], r["sha1"]) for r in rg.file_hashes(spark, str(tmp_path), "*.bin", 256 << 20).collect()}
    parts = []
    with open(tmp_path / "big.BIN", "rb") as f:
        while body := f.read(256 << 20):
            parts.append(hashlib.sha1(body).hexdigest())
    assert got == {
        "big.BIN": (size, hashlib.sha1("".join(parts).encode()).hexdigest()),
        "small.bin": (3, hashlib.sha1(b"abc").hexdigest()), "none.bin": (0, hashlib.sha1(b"").hexdigest()),
    }


@pytest.mark.parametrize("size", [1, 5, 64, 10_000])
def test_text_parts_are_cut_between_lines(spark, tmp_path, size):
    body = "one\ntwo é\n\nlonger line of the file\n" * 9 + "no end"
    (tmp_path / "a.txt").write_text(body)
    (tmp_path / "b.txt").write_text("")
    rows = rg.text_parts(spark, str(tmp_path), range_bytes=size).orderBy("source", "page").collect()
    assert "".join(r["text"] for r in rows if r["source"] == "a.txt") == body
    assert all(r["text"].endswith("\n") for r in rows[:-2] if r["source"] == "a.txt") and rows[-1]["text"] == ""
    pieces = rg.read_ranges(spark, str(tmp_path / "a.txt"), range_bytes=size).orderBy("offset").collect()
    assert b"".join(bytes(r["content"]) for r in pieces) == body.encode()


def test_streamed_ranges_take_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for batch, names in enumerate((["a", "b"], ["c"], [])):
        for n in names:
            (tmp_path / "in" / f"{n}.bin").write_bytes(n.encode() * 10)
        stream = rg.read_ranges(spark, str(tmp_path / "in"), range_bytes=4, stream=True)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len(rows) == 3 * len({r["path"] for r in rows}) == 3 * (2 if batch == 0 else 3)


def test_python_sees_few_texts_at_a_time(spark):
    """A worker's memory must not follow its split: batches of texts and the table of known tokens are bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = spark.createDataFrame([(i, f"word{i} text") for i in range(1300)], "doc_id long, text string").coalesce(1)
    try:
        for make in (em.embed, lambda d: em.embed_safely(d, em.HashedCounts(4)), ig.chunk_recursive):
            spark.conf.set(name, 10_000)
            assert make(df).count() == 1300
            sizes = [r["n"] for r in df.mapInPandas(lambda frames: (f.assign(n=len(f))[["n"]].head(1) for f in frames), "n long").collect()]
            assert max(sizes) <= 500 and sum(sizes) == 1300
        spark.conf.set(name, 7)
        em.embed(df)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
    model = em.HashedCounts()
    for lo in range(0, 200_000, 20_000):
        model(pd.Series([" ".join(f"w{i}" for i in range(lo, lo + 20_000))]))
    assert len(model.known) <= 70_000


def test_small_ranges_share_a_task(spark, tmp_path):
    body = "".join(f"line {i}\n" for i in range(4000))
    (tmp_path / "a.txt").write_text(body)
    (tmp_path / "b.txt").write_text("")
    parts = rg.text_parts(spark, str(tmp_path), range_bytes=1000)
    assert parts.rdd.getNumPartitions() == 1
    rows = parts.filter("source = 'a.txt'").orderBy("page").collect()
    assert len(rows) > 30 and "".join(r["text"] for r in rows) == body
    assert [len(r.ranges) for r in rg.runs_of(rg.ranges_of(rg.listed(str(tmp_path), "b.txt"), 1000))] == [1] and rg.runs_of([]) == []
    assert [len(r.ranges) for r in rg.runs_of(rg.ranges_of(rg.listed(str(tmp_path), "a.txt"), 1000), 3000)][:2] == [3, 3]
