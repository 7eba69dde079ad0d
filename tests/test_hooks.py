"""Model hooks: defaults, custom functions, failing functions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import hooks
from tests.conftest import rows


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(["Hello hello, world", "", None, "a b c d", "Ünï 42 ünï"] * 3)],
                                 "id int, embedding_text string")


def brute(text, dim):
    v = np.zeros(dim)
    for token in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower()):
        if token:
            v[int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % dim] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


@pytest.mark.parametrize("dim", [16, 1536])
def test_default_vectors_equal_brute_force(texts, dim):
    for r in hooks.embed(texts, dim=dim).collect():
        np.testing.assert_allclose(r.vector, brute(r.embedding_text, dim), atol=1e-6)


def test_custom_vectors(texts):
    got = hooks.embed(texts.dropna(), batch_fn=lambda ts: np.array([[len(t), 1.0] for t in ts]))
    assert all(r.vector == [len(r.embedding_text), 1.0] for r in got.collect())


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([(1, "mail a@b.org I code", ["x"]), (2, "clean bio here", ["y"])], "user_id int, bio string, interest_tags array<string>")


def test_cleaning_default(profiles):
    assert rows(hooks.clean_profiles(profiles), "user_id", "sanitized_bio", "enriched_tags", "pii_removed") == [
        (1, "mail [email removed] I code", ["programming", "x"], True), (2, "clean bio here", ["y"], False)]


def test_cleaning_hook_and_fallback(profiles):
    def good(bios, tags):
        return [(b.upper(), [*t, "extra"], True) for b, t in zip(bios, tags)]

    def bad(bios, tags):
        raise RuntimeError("service down")

    assert rows(hooks.clean_profiles(profiles, good), "user_id", "enriched_tags", "pii_removed") == [
        (1, ["x", "extra"], True), (2, ["y", "extra"], True)]
    columns = ["user_id", "sanitized_bio", "enriched_tags", "pii_removed"]
    assert rows(hooks.clean_profiles(profiles, bad), *columns) == rows(hooks.clean_profiles(profiles), *columns)


def test_introductions(spark):
    df = spark.createDataFrame([(1, "Chess Club"), (2, "B" * 300)], "user_id int, community_name string")
    default = rows(hooks.introduce(df), "user_id", "intro_text", "mentioned_member", "toxicity_score", "fits")
    assert default[0] == (1, "Welcome to Chess Club! We're excited to have you here.", None, 0.0, True)
    assert default[1][-1] is False
    hooked = hooks.introduce(df, lambda batch: [(f"Hi {r['community_name']}", "kim", 0.2) for r in batch])
    assert rows(hooked, "user_id", "mentioned_member", "toxicity_score") == [(1, "kim", 0.2), (2, "kim", 0.2)]
    failing = hooks.introduce(df, lambda batch: 1 / 0)
    assert rows(failing, "user_id", "toxicity_score") == [(1, 0.0), (2, 0.0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_one_failing_row_of_many_fails_alone(spark, parts):
    df = spark.range(2000).select("id", F.concat(F.lit("text "), "id").alias("text")).repartition(parts)

    def scores(texts):
        if "text 1234" in texts:
            raise RuntimeError("bad text")
        return np.array([[0.9, 0.1, 0.1, 0.1]] * len(texts))

    got = hooks.score_toxicity(df, batch_fn=scores, key="id").collect()
    assert [(r.id, r.toxicity_score) for r in got if r.model_failed] == [(1234, 0.0)]
    assert all(r.toxicity_score == 0.9 for r in got if r.id != 1234)


def test_results_are_matched_row_by_row():
    short = hooks.by_row(lambda xs: [x * 2 for x in xs if x != 3], int, [1, 2, 3, 4])
    assert short == [2, 4, None, 8]
    assert hooks.by_row(lambda xs: [None if x == 2 else x for x in xs], int, [1, 2, 3]) == [1, None, 3]
    assert hooks.by_row(lambda xs: 1 / 0, int, [1, 2]) == [None, None] and hooks.by_row(lambda xs: xs, int, []) == []


def test_toxicity(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 0.9)], "doc_id int, score double")
    assert rows(hooks.score_toxicity(df, labels=labels), "doc_id", "toxicity_score") == [(1, 0.9), (2, 0.0)]
    hooked = hooks.score_toxicity(df, batch_fn=lambda ts: np.array([[0.1, 0.7, 0.2, 0.3]] * len(ts)))
    assert rows(hooked, "doc_id", "toxicity_score") == [(1, 0.7), (2, 0.7)]
    assert rows(hooks.score_toxicity(df, batch_fn=lambda ts: 1 / 0), "toxicity_score") == [(0.0,), (0.0,)]
    assert "hate" not in hooked.columns
