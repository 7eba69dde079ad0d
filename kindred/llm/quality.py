"""Quality classifier on random-indexing vectors.

Every token (a run of letters, digits or other marks, or a line end; case kept) falls into one of ``BUCKETS`` buckets
and owns a sparse random index vector. Over all documents each bucket sums the index vectors of its neighbours; the
sums, brought to unit length, are the token vectors. A text is pooled to the mean of its vectors and the mean change
from one token to the next. A network of two layers learns the label from a bounded sample of labelled rows (``SAMPLE``
of each label); a fifth of it is kept back to calibrate the probabilities by one temperature.

The vectors are a table of fixed size whatever the corpus: BUCKETS x DIMS numbers travel to the tasks.

Defined cases: null texts count as empty; an empty text is pooled to zeros and scored like any other; a null ``doc_id``
and repeated rows are kept; null labels are left out and of conflicting labels the higher counts; without both labels
every text gets the share of label 1 (0 without any label); other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import sample, slices, texts

TOKENS = regex.compile(r"\p{L}+|\p{N}+|\n|[^\s\p{L}\p{N}]+")
BUCKETS = 1 << 14
DIMS = 32
NONZERO = 4
REACH = 2
SAMPLE = 3000
HIDDEN = 16
THRESHOLD = 0.7
CACHE = 1 << 18
# Tokens that are counted together.
PART = 1 << 20


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of the nonzero entries of every bucket; the bucket after the last one has none."""
    rng = np.random.default_rng(seed)
    dims = rng.random((BUCKETS + 1, DIMS)).argsort(axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    signs[BUCKETS] = 0
    return dims, signs


class Buckets:
    def __init__(self):
        self.known: dict[str, int] = {}

    def new(self, token: str) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[token] = found = 1 + zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
        return found

    def of(self, text: str) -> np.ndarray:
        get, new = self.known.get, self.new
        return np.array([get(t) or new(t) for t in TOKENS.findall(text)], np.int64) - 1


def contexts(lists: Iterable[np.ndarray]) -> np.ndarray:
    """Summed index vectors of the neighbours within ``REACH``, (BUCKETS, DIMS); texts do not touch."""
    dims, signs = index_vectors()
    total = np.zeros((BUCKETS + 1) * DIMS)
    gap = np.full(REACH, BUCKETS)

    def add(parts: list[np.ndarray]):
        line = np.concatenate(parts)
        for off in range(1, REACH + 1):
            for own, other in ((line[:-off], line[off:]), (line[off:], line[:-off])):
                for k in range(NONZERO):
                    total[:] += np.bincount(own * DIMS + dims[other, k], signs[other, k], len(total))

    held, size = [gap], 0
    for ids in lists:
        held += [ids, gap]
        size += len(ids)
        if size >= PART:
            add(held)
            held, size = [gap], 0
    add(held)
    return total.reshape(BUCKETS + 1, DIMS)[:BUCKETS]


def learn_vectors(docs: DataFrame) -> np.ndarray:
    """Token vectors of unit length from all documents; buckets without neighbours stay zero."""
    names = [f"d{i}" for i in range(DIMS)]

    def count(batches):
        buckets = Buckets()
        sums = contexts(buckets.of(t.as_py()) for b in slices(batches) for t in b[0])
        rows = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), *(pa.array(sums[rows, i].astype(np.int64)) for i in range(DIMS))],
            names=["bucket", *names])

    sums = texts(docs).select("text").mapInArrow(count, "bucket int, " + ", ".join(f"{n} long" for n in names))
    # At most BUCKETS rows.
    found = sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    vectors = np.zeros((BUCKETS + 1, DIMS))
    if found.num_rows:
        vectors[found["bucket"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], axis=1)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector and mean absolute change between neighbours, in pieces of bounded size."""
    total, change = np.zeros(DIMS), np.zeros(DIMS)
    for at in range(0, len(ids), PART):
        found = vectors[ids[at:at + PART + 1]]
        total += found[:PART].sum(axis=0, dtype=np.float64)
        change += np.abs(np.diff(found, axis=0)).sum(axis=0, dtype=np.float64)
    return np.concatenate([total / max(1, len(ids)), change / max(1, len(ids) - 1)])


def features(docs: DataFrame, vectors: np.ndarray, network: dict | None = None) -> DataFrame:
    """``doc_id`` with the pooled ``vector`` of each row, or with its ``score`` if a network is given."""
    packed = docs.sparkSession.sparkContext.broadcast((vectors, network))
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        table, net = packed.value
        buckets = Buckets()
        for b in slices(batches):
            pooled = np.array([pool(buckets.of(t.as_py()), table) for t in b.column("text")]).reshape(-1, 2 * DIMS)
            out = pa.array(list(pooled)) if net is None else pa.array(probabilities(net, pooled), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), out],
                                             names=[*kept, "vector" if net is None else "score"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.mapInArrow(run, f"{types}, " + ("vector array<double>" if network is None else "score double"))


def logits(network: dict, rows: np.ndarray) -> np.ndarray:
    scaled = (rows - network["mean"]) / network["scale"]
    return np.tanh(scaled @ network["W"] + network["b"]) @ network["v"] + network["c"]


def probabilities(network: dict, rows: np.ndarray) -> np.ndarray:
    if "constant" in network:
        return np.full(len(rows), network["constant"])
    raised = logits(network, rows) / network["temperature"] + network["prior"]
    return 0.5 + 0.5 * np.tanh(raised / 2)


def fit(rows: np.ndarray, labels: np.ndarray, base: float | None, epochs: int = 60, batch: int = 128,
        rate: float = 0.005, decay: float = 1e-4, seed: int = 5) -> dict:
    """The network, its temperature, and the shift from the sample's balance to the share ``base`` of label 1."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return {"constant": share}
    rng = np.random.default_rng(seed)
    turn = rng.permutation(len(rows))
    kept, learned = turn[::5], np.setdiff1d(turn, turn[::5])
    if len(np.unique(labels[kept])) < 2 or len(np.unique(labels[learned])) < 2:
        kept = learned = turn
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    net = {"mean": rows[learned].mean(axis=0), "scale": rows[learned].std(axis=0) + 1e-3}
    net |= {"W": rng.normal(0, rows.shape[1] ** -0.5, (rows.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
            "v": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "c": np.zeros(())}
    moments = {k: (np.zeros_like(net[k]), np.zeros_like(net[k])) for k in "Wbvc"}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(learned)
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            x = (rows[part] - net["mean"]) / net["scale"]
            inner = np.tanh(x @ net["W"] + net["b"])
            wrong = weight[part] * (0.5 + 0.5 * np.tanh((inner @ net["v"] + net["c"]) / 2) - labels[part]) / len(part)
            back = wrong[:, None] * net["v"] * (1 - inner ** 2)
            grads = {"W": x.T @ back + decay * net["W"], "b": back.sum(axis=0),
                     "v": inner.T @ wrong + decay * net["v"], "c": wrong.sum()}
            step += 1
            for k, (m, v) in moments.items():
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                net[k] = net[k] - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    raw, y, importance = logits(net, rows[kept]), labels[kept], weight[kept]

    def loss(temperature: float) -> float:
        return float((importance * np.logaddexp(0, -np.where(y == 1, raw, -raw) / temperature)).mean())

    net["temperature"] = min(np.geomspace(0.25, 16, 97), key=loss)
    prior = min(max(share if base is None else base, 1e-4), 1 - 1e-4)
    net["prior"] = np.log(prior / (1 - prior))
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", size: int = SAMPLE) -> dict:
    chosen, base = sample(docs, labels, label, size, size)
    rows = sorted(((r.doc_id, r.label, tuple(r.vector)) for r in features(chosen, vectors).collect()))
    return fit(np.array([r[2] for r in rows]).reshape(-1, 2 * DIMS), np.array([r[1] for r in rows], float), base)


def score(docs: DataFrame, vectors: np.ndarray, network: dict) -> DataFrame:
    """``doc_id`` and ``score`` for every row."""
    return features(texts(docs), vectors, network)
