"""Streams against their batch twins; every wait has a time limit."""

from __future__ import annotations

import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftwell.operators import embed as em
from siftwell.sources import files as fs
from siftwell.streaming import ingest as si
from siftwell.streaming import reuse as sr
from siftwell.streaming import windows as sw
from siftwell.streaming.seen import Seen

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Refuses:
    """Embedder that fails on one word."""

    def __init__(self, word: str):
        self.word, self.inner = word, em.HashedCounts(8)

    def __call__(self, texts):
        if any(self.word in t for t in texts):
            raise ValueError("refused")
        return self.inner(texts)


def folders(tmp_path):
    return si.Paths(*(str(tmp_path / n) for n in ("inbox", "index", "dead", "catalog", "metrics", "checkpoint")))


def messages(spark, rows):
    return spark.createDataFrame(rows, "text string, source string, tenant string").withColumn("date", F.lit("2024-01-02"))


def test_bad_rows_fail_alone_and_end_as_dead_letters(spark, tmp_path):
    paths = folders(tmp_path)
    fs.enqueue(messages(spark, [("good doc", "a.pdf", "t"), ("bad doc", "b.pdf", "t"), ("", "c.pdf", "t")]), paths.inbox)
    messages(spark, [("", "d.pdf", "t")]).write.mode("append").json(paths.inbox)
    for attempt in range(3):
        si.run_to_end(si.ingest_stream(spark, paths, Refuses("bad"), max_retries=3), 300)
        dead = {(r["source"], r["reason"].split(":")[0]) for r in spark.read.parquet(paths.dead).collect()}
        assert ("b.pdf", "ValueError") in dead or attempt < 2
    assert dead == {("d.pdf", "empty_text"), ("b.pdf", "ValueError")}
    assert [r["source"] for r in spark.read.parquet(paths.index).collect()] == ["a.pdf"]
    status = {(r["status"]): r["n"] for r in spark.read.parquet(paths.metrics).groupBy("status").agg(F.sum("n").alias("n")).collect()}
    assert status == {"processed": 1, "invalid": 1, "retried": 2, "failed": 1}


class Notes(em.HashedCounts):
    """Default embedder that leaves a line in a file for each text."""

    def __init__(self, path: str):
        super().__init__(8)
        self.path = path

    def __call__(self, texts):
        with open(self.path, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return super().__call__(texts)


def test_a_batch_embeds_each_text_once(spark, tmp_path):
    paths = folders(tmp_path)
    fs.enqueue(messages(spark, [(f"text {i}", "s", "t") for i in range(40)] + [("text 1", "r", "t")]), paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths, Notes(str(tmp_path / "notes"))), 300)
    assert sorted((tmp_path / "notes").read_text().splitlines()) == sorted(f"text {i}" for i in range(40))
    assert spark.read.parquet(paths.index).count() == 40


def test_a_batch_writes_a_file_for_each_folder(spark, tmp_path, monkeypatch):
    paths = folders(tmp_path)
    rows = messages(spark, [(f"text {i}", "s", f"t{i % 2}") for i in range(400)])
    staged = rows.select("tenant", F.col("text").alias("id"), "text", si.prefix_of("text").alias("prefix"), F.lit("processed").alias("status"))
    staged = staged.select("*", *[F.lit(None).cast("string").alias(c) for c in ("error", "attempts", "embed_seconds")]).repartition(8)
    for _ in range(2):  # again, as after a failure
        si.commit_index(staged, "b", paths.index)
        files = [x.parent for x in (tmp_path / "index").rglob("part-*.parquet")]
        assert len(files) == len(set(files)) == 32 and spark.read.parquet(paths.index).count() == 400


def test_a_stream_may_take_its_time(spark, tmp_path):
    """The wait ends with a stream that does nothing, not with one whose work is long: in many batches, or in one of many tasks."""
    for i in range(4):
        spark.range(10).withColumn("i", F.lit(i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    slow = F.udf(lambda x: time.sleep(1.2) or x, "long")
    for files, label in ((1, "batches"), (4, "tasks")):
        rows = spark.readStream.schema("id long, i int").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
        query = rows.filter("id = 0").repartition(1).writeStream.foreachBatch(lambda df, _, f=files: df.repartition(8, "i").coalesce(f).select(slow("id")).collect())
        si.run_to_end(query.option("checkpointLocation", str(tmp_path / label)).trigger(availableNow=True).start(), 3)


def test_messages_and_index_are_packed(spark, tmp_path):
    """Texts are written several times on their way: the inbox, the stage and the index hold them packed."""
    paths = folders(tmp_path)
    fs.enqueue(messages(spark, [(f"text {i}", "s", "t") for i in range(9)]), paths.inbox)
    names = [f for x in (tmp_path / "inbox").rglob("part-*") for f in [x.name]]
    assert names and all(n.endswith(".json.gz") for n in names)
    si.run_to_end(si.ingest_stream(spark, paths), 300)
    assert spark.read.parquet(paths.index).count() == 9
    assert all(".zstd." in x.name for x in (tmp_path / "index").rglob("part-*"))


def test_replay_and_new_messages_keep_one_row_per_text(spark, tmp_path):
    paths = folders(tmp_path)
    fs.enqueue(messages(spark, [(f"text {i % 7}", f"s{i % 3}", "") for i in range(40)]), paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths), 300)
    assert spark.read.parquet(paths.index).count() == 7
    fs.enqueue(messages(spark, [("text 1", "s9", "t"), ("text new", "s1", "t")]), paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths), 300)
    lost = si.Paths(paths.inbox, paths.index, paths.dead, paths.catalog, paths.metrics, paths.checkpoint + "-again")
    query = si.ingest_stream(spark, lost)
    si.run_to_end(query, 300)
    assert si.progress_rows(query)[0]["rows"] == 42
    index = spark.read.parquet(paths.index)
    # "text 1" is known to the first tenant only.
    assert index.count() == index.select("tenant", "id").distinct().count() == 9
    catalog = {tuple(r) for r in si.read_catalog(spark, paths.catalog).collect()}
    assert ("__default__", "date_min", "2024-01-02") in catalog and {c for c in catalog if c[0] == "t" and c[1] == "source"} == {("t", "source", "s1"), ("t", "source", "s9")}


def outputs(spark, paths):
    """All outputs but times and the names of runs."""
    index = sorted((r["tenant"], r["id"], r["source"], r["text"]) for r in spark.read.parquet(paths.index).collect())
    dead = sorted((r["source"], r["reason"]) for r in spark.read.parquet(paths.dead).collect())
    metrics = sorted((r["tenant"], r["status"], r["n"]) for r in spark.read.parquet(paths.metrics).collect())
    return index, dead, metrics, sorted(tuple(r) for r in si.read_catalog(spark, paths.catalog).collect())


@pytest.mark.parametrize("step", ["write_failures", "commit_index", "write_metrics", "delete_folder"])
@pytest.mark.parametrize("after", [False, True])
def test_a_failure_between_any_two_writes_changes_nothing(spark, tmp_path, monkeypatch, step, after):
    rows = [(f"text {i % 5}", f"s{i % 3}", f"t{i % 2}") for i in range(20)] + [("bad doc", "b", "t0"), ("", "e", "t1")]
    calm, shaken = folders(tmp_path / "calm"), folders(tmp_path / "shaken")
    for paths in (calm, shaken):
        fs.enqueue(messages(spark, rows), paths.inbox)
        messages(spark, [("", "d.pdf", "t0")]).write.mode("append").json(paths.inbox)
    si.run_to_end(si.ingest_stream(spark, calm, Refuses("bad"), max_retries=1), 300)
    real = getattr(si, step)

    def broken(*args):
        if after:
            real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(si, step, broken)
    with pytest.raises(Exception, match="lost"):
        si.run_to_end(si.ingest_stream(spark, shaken, Refuses("bad"), max_retries=1), 300)
    monkeypatch.setattr(si, step, real)
    si.run_to_end(si.ingest_stream(spark, shaken, Refuses("bad"), max_retries=1), 300)
    assert outputs(spark, shaken) == outputs(spark, calm)


def test_a_lost_checkpoint_keeps_earlier_dead_letters(spark, tmp_path):
    paths = folders(tmp_path)
    messages(spark, [("", "a.pdf", "t")]).write.json(paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths), 300)
    again = si.Paths(str(tmp_path / "inbox2"), paths.index, paths.dead, paths.catalog, paths.metrics, paths.checkpoint + "2")
    messages(spark, [("", "b.pdf", "t")]).write.json(again.inbox)
    si.run_to_end(si.ingest_stream(spark, again), 300)
    assert {r["source"] for r in spark.read.parquet(paths.dead).collect()} == {"a.pdf", "b.pdf"}


def test_ids_that_agree_in_forty_characters_stay_apart(spark, tmp_path):
    paths = folders(tmp_path)
    long = "x" * 40
    rows = [(long + "a", "one text"), (long + "b", "another text"), (long, "a third"), (long + "a", "one text")]
    spark.createDataFrame([(i, t, "s", "t") for i, t in rows], "id string, text string, source string, tenant string").write.json(paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths), 300)
    assert sorted(r["text"] for r in spark.read.parquet(paths.index).collect()) == ["a third", "another text", "one text"]


def test_new_ids_do_not_read_the_index(spark, tmp_path, monkeypatch):
    """What a batch of new ids reads does not depend on the index; a known one reads folders of its prefix."""
    paths = folders(tmp_path)
    fs.enqueue(messages(spark, [(f"text {i}", "s", "t") for i in range(200)]), paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths), 300)
    real, looks = si.index_ids, []
    monkeypatch.setattr(si, "index_ids", lambda *a: looks.append(a) or real(*a))
    fs.enqueue(messages(spark, [(f"fresh {i}", "s", "t") for i in range(50)]), paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths), 300)
    assert not looks and spark.read.parquet(paths.index).count() == 250
    fs.enqueue(messages(spark, [("text 7", "s", "t"), ("more", "s", "t"), ("text 7", "s", "other")]), paths.inbox)
    si.run_to_end(si.ingest_stream(spark, paths), 300)
    assert len(looks) == 1 and spark.read.parquet(paths.index).count() == 252
    assert len(paths.seen.versions(spark)) <= 3


def test_seen_ids_are_never_forgotten(spark, tmp_path):
    seen = Seen(str(tmp_path / "seen"), bits=1 << 12)
    ids = [spark.createDataFrame([("t", f"{b}-{i}") for i in range(40)], "tenant string, id string") for b in range(4)]
    for part in ids:
        assert seen.maybe_known(part).count() < 20
        seen.add(part)
        seen.add(part)  # again, as after a failure
    for part in ids:
        assert seen.maybe_known(part).count() == 40
    assert seen.maybe_known(spark.createDataFrame([(None, "0-1"), ("u", "0-1")], "tenant string, id string")).count() < 2
    # A table that is far too small knows too much; ids are then looked up in vain, nothing more.
    full = Seen(str(tmp_path / "full"), bits=64)
    full.add(ids[0])
    assert full.maybe_known(ids[1]).count() > 20


def test_starts_without_an_end_are_given_out(spark, tmp_path):
    starts = [(1, 0), (2, 10), (3, 20), (4, 90000)]
    ends = [(1, 30), (3, 20 + 7200), (9, 90000)]  # the third comes too late
    for name, rows in (("a", starts), ("b", ends)):
        # Not at the epoch, where every stream's first watermark stands.
        spark.createDataFrame(rows, "request_id long, s long").select("request_id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts")).coalesce(1).write.parquet(str(tmp_path / name))
    a, b = (read_events(spark, str(tmp_path / n)) for n in "ab")
    si.run_to_end(sw.to_table(sw.stream_durations(a, b, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck")), 300)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 30000), (2, None), (3, None)]


def write_events(spark, folder, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, r.randrange(0, 20000), r.choice(["x", "y"])) for i in range(n)]
    spark.createDataFrame(rows, "id long, s long, kind string").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(folder)
    return rows


def read_events(spark, folder):
    return sw.read_table_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)


def test_closed_windows_equal_batch_counts(spark, tmp_path):
    rows = write_events(spark, str(tmp_path / "in"))
    stream = sw.stream_rate(read_events(spark, str(tmp_path / "in")), ["kind"], "5 minutes")
    si.run_to_end(sw.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")), 300)
    got = {(r["window_start"], r["kind"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = max(r[1] for r in rows) - 600
    expected: dict = {}
    for _, s, kind in rows:
        if s // 300 * 300 + 300 <= closed:
            expected[(s // 300 * 300, kind)] = expected.get((s // 300 * 300, kind), 0) + 1
    assert got == expected


def test_stream_dedup_emits_each_id_once(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"))
    one = read_events(spark, str(tmp_path / "in"))
    both = si.dedup_stream(one.unionByName(read_events(spark, str(tmp_path / "in"))), "id", "ts", "1 day")
    si.run_to_end(sw.to_table(both, str(tmp_path / "out"), str(tmp_path / "ck")), 300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("id").distinct().count() == 300


def test_keyed_reuse_equals_sequential(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = write_events(spark, str(tmp_path / "in"), 200, 3)
    stream = read_events(spark, str(tmp_path / "in")).select(F.col("id").alias("request_id"), F.unix_micros("ts").alias("us"), "kind")
    si.run_to_end(sw.to_table(sr.stream_reuse(stream, ["kind"], 900), str(tmp_path / "out"), str(tmp_path / "ck")), 300)
    got = {r["request_id"]: r["hit"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last: dict = {}
    for i, s, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        hit = kind in last and s - last[kind] < 900
        if not hit:
            last[kind] = s
        assert got[i] == hit


def test_waiting_has_a_limit(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"), 10)
    query = read_events(spark, str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    with pytest.raises(TimeoutError):
        si.run_to_end(query, 5)
    assert not query.isActive
