"""Toxicity, quality and language model."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import lm, quality, queries, toxicity
from tests.llm.conftest import EDGE_ROWS, SF, wide

VOWELS, STEMS = "aeiou", ("grumpf", "zwackel")


def word(rng):
    return "".join(rng.choice("bdklmnprst") + rng.choice(VOWELS) for _ in range(rng.randrange(1, 5)))


def made(rng, count, toxic):
    out = []
    for _ in range(count):
        words = [word(rng) for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(STEMS) + word(rng)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def network():
    rng = random.Random(2)
    return toxicity.fit([(t, 1) for t in made(rng, 150, True)] + [(t, 0) for t in made(rng, 300, False)], 0.3)


def test_toxicity_on_unseen_forms_of_known_stems(network):
    rng = random.Random(3)
    assert (toxicity.scores(network, made(rng, 100, True)) >= 0.3).mean() > 0.9
    assert (toxicity.scores(network, made(rng, 200, False)) >= 0.3).mean() < 0.12


@pytest.mark.parametrize(("sf", "precision", "recall"), [("sf0.01", 0.8, 0.6), ("sf0.1", 0.85, 0.85)])
def test_toxicity_on_held_out_documents(sf, precision, recall):
    import duckdb
    folder = f"/root/testdata/{sf}"
    rows = duckdb.sql(f"SELECT d.doc_id, coalesce(text, ''), toxic FROM '{folder}/documents.parquet' d "
                      f"JOIN '{folder}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL ORDER BY doc_id").fetchall()
    apart = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]
    learned = [(t, y) for (_, t, y), out in zip(rows, apart, strict=True) if not out]
    model = toxicity.fit(learned, float(np.mean([y for _, y in learned])))
    held = [(t, y) for (_, t, y), out in zip(rows, apart, strict=True) if out]
    called = toxicity.scores(model, [t for t, _ in held]) >= toxicity.THRESHOLD
    truth = np.array([y for _, y in held]) == 1
    assert (called & truth).sum() >= precision * called.sum() and (called & truth).sum() >= recall * truth.sum()


def test_a_bounded_sample_of_bytes(spark, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda documents, base: given.append(documents))
    rows = [(i, f"{i:04d}" + "x" * 96) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for room, count in ((1000, 20), (1 << 20, 200)):
        toxicity.train(docs, labels, room=room)
        assert len(given[-1]) == count and {y for _, y in given[-1]} == {0, 1}


def test_executors_need_not_have_the_package(tmp_path):
    """Queries whose tasks hold objects of the package, from a folder and an environment without it."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from kindred.llm import queries
from kindred.session import build_session
spark = build_session("apart", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__checkpoint__dir={str(tmp_path)!r})
for name in ("op6_toxicity", "op11_cosine_duplicates", "op12_repair_conversations", "op13_filter_audit"):
    assert queries.QUERIES[name](spark, {SF!r}).count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def test_gradients_against_differences(network):
    rng = np.random.default_rng(0)
    model = toxicity.Model({}, None, {k: v.astype(np.float64) for k, v in network.weights.items()})
    x = rng.normal(0, 1, (5, 3, toxicity.WORD_DIM + toxicity.GRAM_DIM)).astype(np.float32)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], np.float32)

    def loss():
        inputs = {s: x.astype(np.float64) @ model.weights[f"W{s}"] + model.weights[f"b{s}"] for s in "fb"}
        return float(toxicity.forward(model, inputs, mask).sum())

    _, grads, _ = toxicity.gradients(model, x.astype(np.float64), mask, lambda o: np.ones(len(o)))
    for name in ("Wf", "Ub", "A", "v", "w", "bb"):
        values = model.weights[name].reshape(-1)
        at = int(rng.integers(len(values)))
        old = values[at]
        values[at] = old + 1e-2
        up = loss()
        values[at] = old - 1e-2
        down = loss()
        values[at] = old
        assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-3), name


def test_a_text_scores_as_its_highest_window(network):
    rng = random.Random(8)
    text = made(rng, 1, False)[0] + " grumpfmola " + " ".join(made(rng, 3, False))
    words = toxicity.split(text)
    windows = [" ".join(words[a:a + toxicity.WINDOW]) for a in toxicity.starts(len(words))]
    assert {w for part in windows for w in part.split()} == set(words)
    alone = [float(toxicity.scores(network, [w])[0]) for w in windows if len(w.split()) <= toxicity.WINDOW // 1]
    assert toxicity.scores(network, [text])[0] == pytest.approx(max(alone), rel=1e-4)


def test_toxicity_edges(spark, edge, none, network):
    got = toxicity.score(edge, network).collect()
    assert len(got) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, network).count() == 0 and toxicity.keep_clean(none, network).count() == 0
    rows = wide(spark, [(1, "grumpfbala zwackelto " * 5), (2, None), (None, "bala tono kalu")])
    kept = toxicity.keep_clean(rows, network)
    assert kept.columns == rows.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2]
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels)
    assert set(toxicity.scores(model, ["a", ""])) == {0.0}
    assert set(toxicity.scores(toxicity.train(none, labels.where("doc_id < 0")), ["a"])) == {0.0}


def test_queries_never_learn_from_held_out_labels(spark):
    for name, limit in (("op6_toxicity", 0.3), ("op7_quality", 0.7)):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == 200
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert r.predicted == int(r.score >= limit) and 0 <= r.score <= 1


def test_quality_contexts_equal_plain_sums(docs):
    dims, signs = quality.index_vectors()
    lists = [quality.Buckets().of(t or "") for _, t in docs[:15]]
    plain = np.zeros((quality.BUCKETS, quality.DIMS))
    for ids in lists:
        for i, own in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if j != i:
                    np.add.at(plain[own], dims[ids[j]], signs[ids[j]])
    assert np.array_equal(quality.contexts(lists), plain)


def test_quality_separates_junk(spark):
    rng = random.Random(4)
    good = [t.replace(" m", ". M") for t in made(rng, 250, False)]
    junk = [" | ".join(t.split()) if i % 2 else t.upper().replace(" ", "!! ") for i, t in enumerate(made(rng, 250, False))]
    rows = [(i, t) for i, t in enumerate(good + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 250)) for i in range(500) if i % 5], "doc_id long, quality int")
    vectors = quality.learn_vectors(docs)
    network = quality.train(docs, labels, vectors)
    got = {r.doc_id: r.score for r in quality.score(docs, vectors, network).collect()}
    held = [i for i in range(500) if i % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i < 250) for i in held]) > 0.95


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 1, (3000, 4))
    labels = (rng.random(3000) < 1 / (1 + np.exp(-2 * rows[:, 0]))).astype(float)
    net = quality.fit(rows, labels, float(labels.mean()))
    p = quality.probabilities(net, rows)
    for low in (0.1, 0.4, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - labels[part].mean()) < 0.1


def test_quality_edges(spark, edge, none):
    vectors = quality.learn_vectors(edge)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (8, 0), (None, 1), (6, None)], "doc_id long, quality int")
    network = quality.train(edge, labels, vectors)
    got = quality.score(edge, vectors, network).collect()
    assert len(got) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert not quality.learn_vectors(none).any()
    assert quality.score(none, vectors, network).count() == 0
    alone = quality.train(edge, labels.where("doc_id = 1"), vectors)
    assert {r.score for r in quality.score(edge, vectors, alone).collect()} == {1.0}


class Tree:
    """Context-tree weighting with one dictionary of nodes, straight from its definition."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children, self.memo = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for data in texts:
            for i in range(depth, len(data)):
                path = 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    for d in range(depth + 1):
                        self.counts[data[i - d:i], path][bit] += 1
                        if d:
                            self.children[data[i - d + 1:i], path].add((data[i - d:i], path))
                    path = 2 * path + bit

    def own(self, node):
        a, b = self.counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.memo:
            if len(node[0]) == self.depth:
                self.memo[node] = self.own(node), 1.0
            else:
                own, below = self.own(node), sum(self.weighted(c)[0] for c in self.children.get(node, ()))
                both = np.logaddexp(own, below)
                self.memo[node] = both - math.log(2), math.exp(own - both)
        return self.memo[node]

    def one(self, context, path, d=0):
        node = context[self.depth - d:], path
        a, b = self.counts.get(node, (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return estimate
        share = self.weighted(node)[1]
        return share * estimate + (1 - share) * self.one(context, path, d + 1)

    def score(self, data):
        total = 0.0
        for i in range(self.depth, len(data)):
            path = 1
            for k in range(7, -1, -1):
                p, bit = self.one(data[i - self.depth:i], path), data[i] >> k & 1
                total += math.log10(p if bit else 1 - p)
                path = 2 * path + bit
        return total


def check_scores(rows, got, trained):
    words = Counter()
    for doc_id, text in rows:
        if trained(doc_id):
            words.update((text or "").encode().lower().split())
            words[b""] += 1
    total, distinct = sum(words.values()), len(words)
    tree = Tree([lm.padded(t or "") for d, t in rows if trained(d)], lm.DEPTH)
    for doc_id, text in rows:
        tokens = [*(text or "").encode().lower().split(), b""]
        row = got[doc_id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(words[t] > 0 for t in tokens), total)
        assert row.base_score == pytest.approx(sum(math.log10((words[t] + 1) / (total + distinct + 1)) for t in tokens))
        if len(text or "") < 3000:
            assert row.score == pytest.approx(tree.score(lm.padded(text or "")), rel=1e-9)


@pytest.mark.parametrize("block, broadcast", [(500, 0), (500, 10**6), (1 << 20, 10**6)])
def test_language_model_equals_definition(spark, docs, block, broadcast):
    rows = [(d, (t or "")[:700]) for d, t in docs[:40]] + [(900, None), (901, "ÄÖ unseen 😀 bytes")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(table, F.col("doc_id") % 3 != 0, block, broadcast).collect()}
    check_scores(rows, got, lambda d: d % 3 != 0)


def test_language_model_edges(spark, edge, none):
    got = lm.score(edge, F.col("doc_id") != 8).collect()
    assert len(got) == len(EDGE_ROWS) and all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert lm.score(none, F.lit(True)).count() == 0
    blank = {r.doc_id: r for r in lm.score(edge, F.lit(False)).collect()}
    assert blank[5].train_tokens == 0 and blank[5].base_score == 0 and blank[5].score == pytest.approx(16 * math.log10(0.5))


def test_registered_language_model(spark, docs):
    got = {r.doc_id: r for r in queries.op8_context_tree(spark, SF).collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2) for d, r in got.items())
    counted = sum(len((t or "").encode().lower().split()) + 1 for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2)
    assert {r.train_tokens for r in got.values()} == {counted}
