"""Split windows against plain Python over random logs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import ordered as od


def log(seed: int, n: int = 400):
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(i, r.choice(keys), r.randrange(0, 3000), r.randrange(1, 9)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, sec long, v long").withColumn("ts", F.timestamp_seconds("sec"))


def by_key(rows):
    out: dict = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("max_rows", [None, 50])
def test_running_sum_and_position_match_plain_order(spark, max_rows):
    rows = log(1)
    df = od.running(
        frame(spark, rows), ["k"], ["ts", "id"], od.time_bucket("ts", 100), {"total": F.col("v"), "n": F.lit(1)}, {"top": F.col("v")}, max_rows=max_rows
    )
    got = {r["id"]: (r["total"], r["n"], r["top"]) for r in df.collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        total, top = 0, 0
        for i, row in enumerate(group, start=1):
            total, top = total + row[3], max(top, row[3])
            assert got[row[0]] == (total, i, top)


def test_exclusive_running_and_previous(spark):
    rows = log(2)
    df = od.previous(frame(spark, rows), ["k"], ["ts", "id"], od.time_bucket("ts", 60), "sec", "prev")
    got = {r["id"]: r["prev"] for r in df.collect()}
    for group in by_key(rows).values():
        for before, row in zip([None, *group], group):
            assert got[row[0]] == (None if before is None else before[2])


@pytest.mark.parametrize("max_rows", [None, 40])
@pytest.mark.parametrize("gap", [5, 30, 400])
def test_gap_sessions_match_plain_order(spark, gap, max_rows):
    rows = log(3)
    df = od.gap_sessions(
        frame(spark, rows), ["k"], ["ts", "id"], od.time_bucket("ts", 50), F.col("sec"), F.lit(gap).cast("long"), "s", "p", max_rows=max_rows
    )
    got = {r["id"]: (r["s"], r["p"]) for r in df.collect()}
    for group in by_key(rows).values():
        session = 0
        for i, row in enumerate(group):
            if i == 0 or row[2] - group[i - 1][2] >= gap:
                session += 1
            assert got[row[0]] == (session, i + 1)


def test_halo_blocks_hold_the_rows_before(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "pos")
    blocks: dict = {}
    for r in od.with_halo(df, "pos", 10, 3).collect():
        blocks.setdefault(r["block"], []).append((r["pos"], r["home"]))
    for b, members in blocks.items():
        home = sorted(p for p, h in members if h)
        extra = sorted(p for p, h in members if not h)
        if home:
            assert home == list(range(b * 10 + 1, b * 10 + 11))
        assert extra == (list(range(b * 10 - 2, b * 10 + 1)) if b else [])


def test_keep_latest_global_and_per_key(spark):
    rows = log(4)
    df = frame(spark, rows)
    order = [F.col("ts").desc(), F.col("id").desc()]
    newest = [r["id"] for r in od.keep_latest(df, 7, order).collect()]
    assert newest == [r[0] for r in sorted(rows, key=lambda r: (-r[2], -r[0]))[:7]]
    per_key: dict = {}
    for r in od.keep_latest(df, 5, order, ["k"]).collect():
        per_key.setdefault(r["k"], set()).add(r["id"])
    for k, group in by_key(rows).items():
        assert per_key[k] == {r[0] for r in group[-5:]}


def test_percentiles_are_exact_with_hot_values(spark):
    r = random.Random(5)
    rows = [("a", 1.0)] * 200 + [("a", r.random() * 10) for _ in range(301)] + [("b", 2.5)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(g["k"], g["p"]): g["pctl"] for g in od.rank_percentiles(df, ["k"], "x", [0.5, 0.95]).collect()}
    for k in ("a", "b"):
        values = sorted(v for g, v in rows if g == k)
        for p in (0.5, 0.95):
            assert got[(k, p)] == values[round(p * (len(values) - 1))]


def test_latest_rows_are_limited_before_the_shuffle(spark):
    df = od.keep_latest(frame(spark, log(6)), 5, [F.col("ts").desc(), F.col("id").desc()], ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rows_without_a_time_come_first_and_stay(spark):
    rows = [(1, "a", 5, 1), (2, "a", None, 1), (3, "a", 90, 1), (4, None, None, 1)]
    got = {r["id"]: r["n"] for r in od.position(frame(spark, rows), ["k"], ["ts", "id"], od.time_bucket("ts", 10)).collect()}
    assert got == {2: 1, 1: 2, 3: 3, 4: 1}
