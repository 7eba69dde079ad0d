"""Text expressions and row rules, compared with plain Python."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators import validation as V
from tests.conftest import rows


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def python_mask(text):
    text = re.sub(X.EMAIL_PATTERN, X.EMAIL_MASK, text)
    return re.sub(X.PHONE_PATTERN, X.PHONE_MASK, text)


TEXTS = ["write to ann.lee+x@mail.example.org now", "call 555-123-4567 or 555.123.4567, 5551234567", "x555-123-45678", "a@b.c",
         "é1@é.org bob@example.com", "id 12345678901", "a@b.co|d 555-1234567", "no pii", "mail me@x.io.", "٥٥٥-١٢٣-٤٥٦٧"]


def test_mask_equals_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(X.mask_pii(F.col("t"))).collect()]
    assert got == [python_mask(t) for t in TEXTS]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1.-@ 5|_%+\n", max_size=40), min_size=20, max_size=40))
def test_mask_random(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.mask_pii(F.col("t"))).collect()] == [python_mask(t) for t in texts]


def test_strip_equals_python(spark):
    texts = [" a ", "\t\x1f a b  　", " x ", "", " \n", "​z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_tags(spark):
    tags = [" Python ", "python", "", "  ", "AI", "\tai"]
    assert one(spark, tags, X.normalize_tags, "array<string>") == ["ai", "python"]
    assert one(spark, ["", " "], X.normalize_tags, "array<string>") == []


def test_enrichment_matches_whole_words(spark):
    def tags(bio):
        return one(spark, bio, lambda c: X.enrich_tags(c, F.array(F.lit("music"))))
    assert tags("I CODE daily, in Python") == ["music", "programming"]
    assert tags("decoded games") == ["music"]
    assert tags("game-night and data") == ["data science", "gaming", "music"]


def test_embedding_text(spark):
    df = spark.createDataFrame([("hi", ["a", "b"]), ("x", [])], "b string, t array<string>")
    assert [r[0] for r in df.select(X.embedding_text(F.col("b"), F.col("t"))).collect()] == [
        "Bio: hi\nInterests: a, b", "Bio: x\nInterests: "]


def test_display(spark):
    assert one(spark, 0.874, X.percent, "double") == "87%"
    assert one(spark, 1234567, X.with_separators, "int") == "1,234,567"


@pytest.mark.parametrize("bio,reason", [
    ("x" * 9, "bio too short"), ("x" * 10, None), ("x" * 500, None), ("x" * 501, "bio too long"),
    ("   short   ", "bio blank"), (None, "bio missing"), ("  ten chars!  ", None)])
def test_bio_rule(spark, bio, reason):
    assert one(spark, bio, V.bio_rule) == reason


@pytest.mark.parametrize("n,reason", [(0, "tag count"), (1, None), (20, None), (21, "tag count")])
def test_tag_count(spark, n, reason):
    assert one(spark, ["t"] * n, V.tag_count_rule, "array<string>") == reason


def test_range_rule(spark):
    df = spark.createDataFrame([(-1,), (0,), (200,), (None,)], "v int")
    assert [r[0] for r in df.select(V.range_rule(F.col("v"), 0, None, "bad")).collect()] == ["bad", None, None, "bad"]


def test_split_is_a_partition(spark):
    df = spark.createDataFrame([("x" * n,) for n in (3, 10, 600)], "bio string")
    good, bad = V.split(df, [V.bio_rule(F.col("bio"))])
    assert good.count() == 1 and rows(bad, "reason") == [("bio too long",), ("bio too short",)]


def test_key_and_reference_audits(spark):
    child = spark.createDataFrame([(1, "a"), (2, "a"), (2, "zz"), (3, None)], "id int, owner string")
    parent = spark.createDataFrame([("a",)], "user_id string")
    assert rows(V.key_violations(child, "child", ["id"], ["owner"])) == [("child", "duplicate key", 1), ("child", "null owner", 1)]
    assert rows(V.orphans(child.dropna(), parent, "owner", "user_id", "fk")) == [("fk", "zz", 1)]
