"""Text and scalar functions."""

from __future__ import annotations

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from siftwell.functions import scalars as sc
from siftwell.functions import text as tx


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("password = hunter22, done", "password: [REDACTED_SECRET] done"),
        ("API_KEY: 'abcd-efgh-1234'", "API_KEY: [REDACTED_SECRET]"),
        ("token=short", "token=short"),
        ("Secret=ABCDEFGH1", "Secret: [REDACTED_SECRET]"),
    ],
)
def test_secrets(spark, text, expected):
    assert one(spark, text, tx.redact_secrets) == expected


def test_pii_matches_python_patterns(spark):
    samples = ["mail a.b+c@x-y.org now", "call +49 170 123 45 67 soon", "id AB12CD34EF é12345678", "née12345678 ok", "1234567"]
    for s in samples:
        t = re.sub(tx.EMAIL, "[REDACTED_EMAIL]", s)
        t = re.sub(tx.PHONE, "[REDACTED_PHONE]", t)
        t = re.sub(tx.ID, "[REDACTED_ID]", t)
        assert one(spark, s, tx.redact_pii) == t


def test_tokens_split_like_python(spark):
    s = " A b\tC d\x1ce　f  "
    assert one(spark, s, tx.tokens) == s.lower().split()


def pieces(text):
    out, words, used = [], [], 0
    for w in text.split():
        words.append(w)
        used += len(w) + 1
        if used >= 128:
            out.append(" ".join(words))
            words, used = [], 0
    return out + ([" ".join(words)] if words else [])


def test_answer_pieces(spark):
    for text in ("", "word", "lorem ipsum dolor " * 40, "x" * 300 + " tail"):
        got = one(spark, text, tx.answer_chunks)
        assert got == pieces(text)
        assert " ".join(got).split() == text.split()


def test_answer_pieces_of_odd_texts(spark):
    rng = random.Random(21)
    spaces = [" ", "  ", "\n", " \r\n", "\t", "\x1c", "\x85", "\u00a0", "\u2009 ", "\u2028", "\u3000"]
    near = ["".join(rng.choice("aé字😀\u0301") for _ in range(n)) for n in (1, 1, 2, 3, 5, 60, 125, 126, 127, 128, 129, 400)]
    texts = [None, " ", "\n\x85", "\u200b", *near, *[f"{w} t" for w in near], *[f"\n{w} a b " for w in near]]
    texts += ["".join(rng.choice(near) + rng.choice(spaces) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.answer_chunks(F.col("t")).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert got == {i: pieces(t or "") for i, t in enumerate(texts)}


def test_answer_pieces_take_two_scans(spark):
    """The registered query neither splits words anew for sizes and pieces nor sends them to Python."""
    from siftwell.plans import catalog

    df = catalog.QUERIES["x16_answer_chunks"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract_all(") == 1
    assert "split(" not in plan and "evalpython" not in plan


def test_expansion_intent_and_arithmetic(spark):
    assert one(spark, "UAV and GNC aero", tx.expand_query) == "UAV and GNC aero unmanned aerial vehicle guidance navigation and control aerodynamics"
    assert one(spark, "plain", tx.expand_query) == "plain"
    assert one(spark, "Stack Trace of build", tx.classify_intent) == "troubleshoot"
    assert one(spark, "please explain", tx.classify_intent) == "explore"
    assert one(spark, "w " * 21, tx.classify_intent) == "explore"
    assert one(spark, "w " * 20, tx.classify_intent) == "lookup"
    assert one(spark, " (1 + 2) * 3.5 / 4 ", tx.is_arithmetic) is True
    assert one(spark, "2 ^ 3", tx.is_arithmetic) is False
    assert one(spark, "  ", tx.is_arithmetic) is False


def test_blocked_pattern_takes_config_order(spark):
    df = spark.createDataFrame([("Please DROP table now", ["", "table", "Drop Table"])], "q string, p array<string>")
    assert df.select(tx.blocked_pattern(F.col("q"), F.col("p"))).first()[0] == "table"
    none = spark.createDataFrame([("fine", None)], "q string, p array<string>")
    assert none.select(tx.blocked_pattern(F.col("q"), F.col("p"))).first()[0] is None


def test_prompt_assembly(spark):
    df = spark.createDataFrame([("new?", [("q2", "a2"), ("q1", "a1")], " Be brief "), ("new?", [], None)], "q string, h array<struct<q:string,a:string>>, s string")
    got = [r[0] for r in df.select(tx.assemble_prompt(F.col("q"), F.col("h"), F.col("s"))).collect()]
    assert got[0] == (
        "Follow these tenant-specific instructions when answering:\nBe brief\n\nQuestion: Previous context (most recent first):\n"
        "Q: q2\nA: a2\nQ: q1\nA: a1\n\nNew question: new?"
    )
    assert got[1] == "new?"


def test_tenant_is_the_uuid_prefix(spark):
    for key in ("demo-key", "k", "ünï"):
        assert one(spark, key, sc.tenant_from_key) == str(uuid.uuid5(uuid.NAMESPACE_DNS, key))[:8]
    assert one(spark, "", sc.tenant_from_key) == "anon" == one(spark, None, sc.tenant_from_key)


def test_maps_days_and_types(spark):
    assert one(spark, " a:1 , b : 2,", sc.parse_map) == {"a": "1", "b": "2"}
    assert str(one(spark, "2024-02-03T10:00:00Z", sc.iso_day)) == "2024-02-03"
    assert one(spark, "tomorrow", sc.iso_day) is None
    assert [one(spark, s, sc.doc_type_of) for s in ("A.PDF", "x.htm", "y.Docx", "z", None)] == ["pdf", "html", "docx", "other", "other"]


def test_token_estimate_floor_and_minimum(spark):
    df = spark.createDataFrame([("abc", "defgh"), ("", None)], "a string, b string")
    assert [r[0] for r in df.select(tx.estimate_tokens(F.col("a"), F.col("b"))).collect()] == [2, 1]
