"""Toxicity scores from a small bidirectional gated recurrent network, written and trained in numpy.

A word enters as its own vector (if the training sample holds it often enough) and as the mean of the vectors of its
character n-grams, so unseen forms of a known stem are recognised. The network reads windows of ``WINDOW`` words that
overlap by half; attention pools the states of a window to one logit, and the highest window gives a text its score.

Training takes a bounded sample: at most ``SAMPLE`` documents of label 1 and ``CLEAN`` times as many of label 0, and at
most ``ROOM`` bytes of each, in the order of a hash of the id. All windows of a document of label 1 take part, and at
most ``BAG`` of one of label 0, all of which are clean. Words start with the evidence that the sample's documents give.
First every window carries its document's label, then only the highest window of each document does. Everything else
(scoring) covers all rows and whole texts.

Defined cases: null texts count as empty; a text without words scores like a window without words; a null ``doc_id``
and repeated rows are kept; null labels are left out and of conflicting labels the higher counts; without both
labels in the training rows every text gets the share of label 1 (0 without any label); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import sample, slices, texts

WORDS = regex.compile(r"\p{L}+")
WINDOW = 32
STEP = 16
SAMPLE = 1500
CLEAN = 3
ROOM = 32 << 20
BAG = 48
WORD_DIM, GRAM_DIM, HIDDEN = 8, 12, 8
MAX_WORDS, MAX_GRAMS = 20_000, 40_000
# An n-gram or word is known if enough documents of the sample hold it: a share of those with label 1, within limits.
LEAST_DOCS, LEAST_WORD_DOCS = (0.06, 2, 8), (0.08, 3, 20)
# In a sample with fewer than ``FULL`` documents of a label every ``WATCH``-th watches over the training instead of taking
# part, and the weights that did best by them stay; not so with under twice ``WATCH``, where none can be spared.
WATCH, FULL = 5, 200
# Documents of label 1 from which on the vectors of words learn as fast as the network.
ENOUGH = 250
# Deviations that rare words reach by chance.
CHANCE = 2.5
LEAST_STEPS = 80
GRAMS = (3, 5)
SLOTS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)
CACHE = 1 << 17
THRESHOLD = 0.3
# Characters of text that are scored together.
PART = 1 << 20


def split(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def starts(count: int) -> range:
    """Starts of the windows that cover ``count`` words; at least one window."""
    return range(0, max(1, count - (WINDOW - STEP)), STEP)


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the character n-grams of words with marked ends, and the number of the word each belongs to."""
    marked = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    codes, owners = [], []
    for n in GRAMS:
        code = np.full(max(0, len(marked) - n + 1), n, np.uint64)
        for k in range(n):
            code = code * MIX + marked[k:k + len(code)]
        whole = owner[:len(code)] == owner[n - 1:]
        codes.append(code[whole])
        owners.append(owner[:len(code)][whole])
    codes, owners = np.concatenate(codes), np.concatenate(owners)
    codes ^= codes >> np.uint64(31)
    order = np.argsort(owners, kind="stable")
    return codes[order] * MIX, owners[order]


class Grams:
    """Numbers of the known n-grams, from 1; 0 for others. Of n-grams that share a slot the commonest is known."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.numbers = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
        slots = codes >> np.uint64(64 - SLOTS)
        _, first = np.unique(slots, return_index=True)
        self.codes[slots[first]], self.numbers[slots[first]] = codes[first], first + 1
        self.count = len(codes)

    def find(self, codes: np.ndarray) -> np.ndarray:
        slots = codes >> np.uint64(64 - SLOTS)
        return np.where(self.codes[slots] == codes, self.numbers[slots], 0)


@dataclass
class Model:
    words: dict[str, int]
    grams: Grams | None
    weights: dict[str, np.ndarray]
    constant: float | None = None


class Table:
    """The projected inputs of words met so far (row 0: padding); owned by a task, so that it goes with it."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1, 6 * HIDDEN), np.float32)


def new_model(words: list[str], grams: Grams, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    size = WORD_DIM + GRAM_DIM
    weights = {"E": np.zeros((len(words) + 1, WORD_DIM)), "C": np.zeros((grams.count + 1, GRAM_DIM))}
    for side in "fb":
        weights |= {f"W{side}": rng.normal(0, size ** -0.5, (size, 3 * HIDDEN)), f"b{side}": np.zeros(3 * HIDDEN),
                    f"U{side}": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN))}
    weights |= {"A": rng.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, HIDDEN)), "a": np.zeros(HIDDEN),
                "v": rng.normal(0, 1, HIDDEN), "w": rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN), "c": np.zeros(1)}
    return Model({w: i + 1 for i, w in enumerate(words)}, grams,
                 {k: x.astype(np.float32) for k, x in weights.items()})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward(model: Model, inputs: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
    """Logits of windows. ``inputs``: projected inputs of both directions, (steps, windows, 3 hidden)."""
    p, (steps, count) = model.weights, mask.shape
    states = np.zeros((steps, count, 2 * HIDDEN), np.float32)
    trace: dict[str, list] = {"f": [], "b": []}
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((count, HIDDEN), np.float32)
        at = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
        for t in order:
            x, u = inputs[side][t], h @ p[f"U{side}"]
            gates = sigmoid(x[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
            new = n + z * (h - n)
            new = h + (new - h) * mask[t][:, None]
            if keep:
                trace[side].append((t, h, z, r, n, u[:, 2 * HIDDEN:]))
            h = states[t, :, at] = new
    inner = np.tanh(states @ p["A"] + p["a"])
    raised = np.exp(np.clip(inner @ p["v"], -30, 30)) * mask
    alpha = raised / np.maximum(raised.sum(axis=0), 1e-9)
    pooled = (alpha[:, :, None] * states).sum(axis=0)
    logits = pooled @ p["w"] + p["c"][0]
    return (logits, states, inner, alpha, pooled, trace) if keep else logits


def gradients(model: Model, x: np.ndarray, mask: np.ndarray, error) -> tuple[np.ndarray, dict, np.ndarray]:
    """Logits, weight gradients and the gradient of the inputs ``x`` (steps, windows, size); ``error``(logits)."""
    p = model.weights
    inputs = {s: x @ p[f"W{s}"] + p[f"b{s}"] for s in "fb"}
    logits, states, inner, alpha, pooled, trace = forward(model, inputs, mask, keep=True)
    wrong = error(logits).astype(np.float32)
    g = {"w": pooled.T @ wrong, "c": np.array([wrong.sum()], np.float32)}
    d_pooled = wrong[:, None] * p["w"]
    d_alpha = (states * d_pooled).sum(axis=2)
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["v"] = np.einsum("tn,tnh->h", d_score, inner)
    d_inner = d_score[:, :, None] * p["v"] * (1 - inner ** 2)
    flat = states.reshape(-1, 2 * HIDDEN)
    g["A"], g["a"] = flat.T @ d_inner.reshape(-1, HIDDEN), d_inner.sum(axis=(0, 1))
    d_states = alpha[:, :, None] * d_pooled + d_inner @ p["A"].T
    d_x = np.zeros_like(x)
    for side in "fb":
        at = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
        d_in = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
        g[f"U{side}"] = np.zeros_like(p[f"U{side}"])
        d_h = np.zeros((mask.shape[1], HIDDEN), np.float32)
        for t, h, z, r, n, u_n in reversed(trace[side]):
            d_h = d_h + d_states[t, :, at]
            m = mask[t][:, None]
            d_new, d_h = d_h * m, d_h * (1 - m)
            d_n = d_new * (1 - z) * (1 - n ** 2)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * u_n * r * (1 - r)
            d_in[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g[f"U{side}"] += h.T @ d_u
            d_h = d_h + d_new * z + d_u @ p[f"U{side}"].T
        g[f"W{side}"] = x.reshape(-1, x.shape[2]).T @ d_in.reshape(-1, 3 * HIDDEN)
        g[f"b{side}"] = d_in.sum(axis=(0, 1))
        d_x += d_in @ p[f"W{side}"].T
    return logits, g, d_x


class Lexicon:
    """The sample's words (rows from 1, row 0 is padding): ids of their vectors, and of the n-grams of each."""

    def __init__(self, names: list[str]):
        self.names, self.word = names, np.zeros(len(names) + 1, np.int32)

    def parts_of(self, step: int = 1 << 15):
        """Codes and owners (rows) of the words' n-grams, some words at a time."""
        for at in range(0, len(self.names), step):
            codes, owners = gram_codes(self.names[at:at + step])
            yield codes, owners + at + 1

    def number(self, model: Model):
        self.word[1:] = [model.words.get(w, 0) for w in self.names]
        found = [(model.grams.find(codes), owners) for codes, owners in self.parts_of()]
        self.gram = np.concatenate([np.zeros(1, np.int32), *(g for g, _ in found)])
        self.sizes = np.bincount(np.concatenate([o for _, o in found]), minlength=len(self.word))
        self.sizes[0] = 1
        self.first = np.cumsum(self.sizes) - self.sizes

    def vectors(self, model: Model, used: np.ndarray) -> np.ndarray:
        gram, _, sizes = self.parts(used)
        sums = np.add.reduceat(model.weights["C"][gram], np.cumsum(sizes) - sizes, axis=0)
        return np.concatenate([model.weights["E"][self.word[used]], sums / sizes[:, None]], axis=1).astype(np.float32)

    def parts(self, used: np.ndarray):
        sizes = self.sizes[used]
        owner = np.repeat(np.arange(len(used)), sizes)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.gram[self.first[used][owner] + within], owner, sizes


def _summed(index: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    size = values.shape[1]
    flat = (index[:, None] * size + np.arange(size)).ravel()
    return np.bincount(flat, values.ravel(), count * size).reshape(count, size).astype(np.float32)


def least(rule: tuple[float, int, int], positive: int) -> float:
    share, low, high = rule
    return min(high, max(low, share * positive))


def evidence(docs: np.ndarray, totals: list[int]) -> np.ndarray:
    """How much a word speaks for label 1 (or against it, below 0): by how many standard deviations beyond ``CHANCE`` the
    log odds of the documents that hold it differ from none."""
    clean, toxic = docs + 0.5
    odds = np.log(toxic / (totals[1] + 1)) - np.log(clean / (totals[0] + 1))
    beyond = odds / np.sqrt(1 / toxic + 1 / clean)
    return (np.sign(beyond) * np.maximum(np.abs(beyond) - CHANCE, 0)).astype(np.float32)


def fit(documents: list[tuple[str, int]], base: float | None = None, noisy: int = 3, sharp: int = 4,
        batch: int = 256, rate: float = 0.01, seed: int = 7) -> Model:
    """Train on (text, label) pairs; ``base``: the share of label 1 among all rows that the sample stands for."""
    rng = np.random.default_rng(seed)
    documents = sorted(documents)
    share = float(np.mean([y for _, y in documents])) if documents else 0.0
    if share in (0.0, 1.0):
        return Model({}, None, {}, share)
    index: dict[str, int] = {}
    parts, owner, seen = [], [], []
    for d, (text, y) in enumerate(documents):
        words = split(text)
        at = np.array(starts(len(words)))
        if not y and len(at) > BAG:
            at = np.sort(rng.choice(at, BAG, replace=False))
        line = np.zeros(max(at[-1] + WINDOW, len(words)), np.int32)
        line[:len(words)] = [index.setdefault(w, len(index) + 1) for w in words]
        parts.append(line[at[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(at), d))
        seen.append(np.unique(parts[-1]))
    ids, owner = np.concatenate(parts), np.concatenate(owner)
    labels = np.array([y for _, y in documents], np.float32)
    watching = np.zeros(len(documents), bool)
    rarer = min(labels.sum(), (1 - labels).sum())
    for y in (0, 1):
        watching[rng.permutation(np.flatnonzero(labels == y))[::WATCH]] = 2 * WATCH <= rarer < FULL
    lexicon = Lexicon(list(index))
    if not index:
        return Model({}, None, {}, share)
    # Documents of either label that hold a word; those that watch do not count.
    seen = np.array([np.bincount(np.concatenate([np.zeros(0, np.int64), *(
        w for w, y, off in zip(seen, labels, watching, strict=True) if y == label and not off)]).astype(np.int64),
        minlength=len(index) + 1) for label in (0, 1)])
    totals = [int(((labels == y) & ~watching).sum()) for y in (0, 1)]
    del parts, index
    codes, docs = np.zeros(0, np.uint64), np.zeros((2, 0))
    for found, owners in lexicon.parts_of():
        codes, place = np.unique(np.concatenate([codes, found]), return_inverse=True)
        docs = np.array([np.bincount(place, np.concatenate([docs[y], seen[y][owners]])) for y in (0, 1)])
    chosen = np.argsort(-docs.sum(axis=0), kind="stable")[:MAX_GRAMS]
    chosen = chosen[docs.sum(axis=0)[chosen] >= least(LEAST_DOCS, totals[1])]
    common = np.argsort(-seen[:, 1:].sum(axis=0), kind="stable")[:MAX_WORDS]
    common = common[seen[:, 1:].sum(axis=0)[common] >= least(LEAST_WORD_DOCS, totals[1])]
    model = new_model([lexicon.names[i] for i in common], Grams(codes[chosen]), seed)
    model.weights["E"][1:, 0] = evidence(seen[:, common + 1], totals)
    model.weights["C"][1:, 0] = evidence(docs[:, chosen], totals)
    lexicon.number(model)
    # Both labels weigh the same while learning; the prior of label 1 comes back in the last step.
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in model.weights.items()}
    step = 0

    # With few documents of label 1 words keep what they start with, and the network learns to read it.
    slow = rate * min(1.0, totals[1] / ENOUGH)

    def learn(rows: np.ndarray):
        nonlocal step
        used, place = np.unique(ids[rows].T, return_inverse=True)
        place = place.reshape(WINDOW, len(rows))
        vectors = lexicon.vectors(model, used)
        mask = (ids[rows].T != 0).astype(np.float32)
        y, importance = labels[owner[rows]], weight[owner[rows]]
        _, g, d_x = gradients(model, vectors[place], mask, lambda o: importance * (sigmoid(o) - y) / len(rows))
        d_v = _summed(place.ravel(), d_x.reshape(-1, d_x.shape[2]), len(used))
        g["E"] = _summed(lexicon.word[used], d_v[:, :WORD_DIM], len(model.weights["E"]))
        gram, of, sizes = lexicon.parts(used)
        g["C"] = _summed(gram, (d_v[:, WORD_DIM:] / sizes[:, None])[of], len(model.weights["C"]))
        g["E"][0], g["C"][0] = 0, 0
        step += 1
        for k, (m, v) in moments.items():
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            move = m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
            model.weights[k] -= ((slow if k in "EC" else rate) * move).astype(np.float32)

    def watched() -> float:
        """Mean loss, both labels weighing the same, of the documents that watch."""
        mine = np.flatnonzero(watching[owner])
        top = np.full(len(documents), -np.inf)
        np.maximum.at(top, owner[mine], everything.logits(ids[mine]))
        loss = np.logaddexp(0, np.where(labels == 1, -top, top))
        return float(np.average(loss[watching], weights=weight[watching]))

    everything = _Scorer(model, lexicon)
    best, kept = np.inf, {}
    # A small sample is read more often, so that each phase takes its ``LEAST_STEPS``.
    noisy = max(noisy, -(-LEAST_STEPS * batch // (4 * len(documents))))
    sharp = max(sharp, -(-LEAST_STEPS * batch // (2 * len(documents))))
    for epoch in range(noisy + sharp):
        if epoch < noisy:
            # As many windows as there are documents times four, each label half of them.
            halves = [np.flatnonzero((labels[owner] == y) & ~watching[owner]) for y in (0, 1)]
            rows = np.concatenate([rng.choice(h, 2 * len(documents)) for h in halves])
        else:
            logits = everything.logits(ids)
            order = np.lexsort((-logits, owner))
            top = order[np.concatenate([[True], np.diff(owner[order]) != 0])]
            top = top[~watching[owner[top]]]
            rows = np.concatenate([top, rng.permutation(top)])
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            learn(rows[at:at + batch])
        if epoch >= noisy - 1 and watching.any() and (loss := watched()) < best:
            best, kept = loss, {k: x.copy() for k, x in model.weights.items()}
    model.weights |= kept
    prior = min(max(base or share, 1e-4), 1 - 1e-4)
    model.weights["c"] += np.float32(np.log(prior / (1 - prior)))
    return model


class _Scorer:
    """Logits of the sample's windows with the current weights."""

    def __init__(self, model: Model, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon

    def logits(self, ids: np.ndarray) -> np.ndarray:
        p, every = self.model.weights, np.arange(len(self.lexicon.sizes))
        rows = np.zeros((len(every), 6 * HIDDEN), np.float32)
        for at in range(0, len(every), 8192):
            vectors = self.lexicon.vectors(self.model, every[at:at + 8192])
            for side, columns in (("f", slice(0, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, None))):
                rows[at:at + 8192, columns] = vectors @ p[f"W{side}"] + p[f"b{side}"]
        return window_logits(self.model, rows, ids)


def window_logits(model: Model, rows: np.ndarray, ids: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Logits of windows of row numbers (0: padding) into the table of projected words."""
    out = np.zeros(len(ids), np.float32)
    for at in range(0, len(ids), batch):
        part = ids[at:at + batch].T
        x = rows[part]
        out[at:at + batch] = forward(
            model, {"f": x[:, :, :3 * HIDDEN], "b": x[:, :, 3 * HIDDEN:]}, (part != 0).astype(np.float32))
    return out


def scores(model: Model, given: list[str], table: Table | None = None) -> np.ndarray:
    """Scores of whole texts: the highest of all overlapping windows."""
    if model.constant is not None:
        return np.full(len(given), model.constant)
    table = table or Table()
    best = np.full(len(given), -np.inf)
    at = 0
    while at < len(given):
        end, chars = at, 0
        while end < len(given) and (end == at or chars < PART):
            chars += len(given[end])
            end += 1
        lists = [split(t) for t in given[at:end]]
        rows, index = project(model, table, {w for words in lists for w in words})
        lines, owners = [], []
        for i, words in enumerate(lists):
            count = len(starts(len(words)))
            line = np.zeros((count - 1) * STEP + WINDOW, np.int64)
            line[:len(words)] = [index[w] for w in words]
            lines.append(np.lib.stride_tricks.sliding_window_view(line, WINDOW)[::STEP])
            owners.append(np.full(count, at + i))
        np.maximum.at(best, np.concatenate(owners), window_logits(model, rows, np.concatenate(lines)))
        at = end
    return sigmoid(best)


def project(model: Model, table: Table, words: set[str]) -> tuple[np.ndarray, dict[str, int]]:
    """The table of projected words with at least all the given ones, and their rows in it (row 0: padding)."""
    if len(table.index) > CACHE:
        table.__init__()
    index = table.index
    new = [w for w in words if w not in index]
    if new:
        count = len(index) + 1
        index.update((w, count + k) for k, w in enumerate(new))
        if len(table.rows) < count + len(new):
            room = np.zeros((count + len(new) + len(new) // 2, 6 * HIDDEN), np.float32)
            room[:len(table.rows)] = table.rows
            table.rows = room
        p = model.weights
        for at in range(0, len(new), 8192):
            part = new[at:at + 8192]
            codes, owners = gram_codes(part)
            sizes = np.bincount(owners, minlength=len(part))
            means = np.add.reduceat(p["C"][model.grams.find(codes)], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            vectors = np.concatenate([p["E"][[model.words.get(w, 0) for w in part]], means], axis=1)
            table.rows[count + at:count + at + len(part)] = np.concatenate(
                [vectors @ p["Wf"] + p["bf"], vectors @ p["Wb"] + p["bb"]], axis=1)
    return table.rows, index


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", size: int = SAMPLE, room: int = ROOM) -> Model:
    """Learn from at most ``size`` documents of label 1 and ``CLEAN`` times as many of label 0, and of each label from
    ``room`` bytes of text at most: ids in the order of a hash until either is reached."""
    chosen, base = sample(docs, labels, label, CLEAN * size, size)
    sizes = chosen.select("doc_id", "label", F.xxhash64("doc_id").alias("at"), F.octet_length("text").alias("bytes")).toArrow().to_pylist()
    held, used = set(), [0, 0]
    for row in sorted(sizes, key=lambda r: (r["at"], r["doc_id"], r["bytes"])):
        if used[row["label"]] + row["bytes"] <= room:
            used[row["label"]] += row["bytes"]
            held.add(row["doc_id"])
    if len(held) < len({r["doc_id"] for r in sizes}):
        chosen = chosen.where(F.col("doc_id").isin(sorted(held)))
    return fit([(r.text, r.label) for r in chosen.collect()], base)


def plain(model: Model) -> tuple:
    """The model as plain values, which workers can read without this package."""
    grams = model.grams and (model.grams.codes, model.grams.numbers, model.grams.count)
    return model.words, grams, model.weights, model.constant


def restored(words: dict, grams: tuple | None, weights: dict, constant: float | None) -> Model:
    known = None
    if grams:
        known = Grams(np.zeros(0, np.uint64))
        known.codes, known.numbers, known.count = grams
    return Model(words, known, weights, constant)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for every row."""
    packed = docs.sparkSession.sparkContext.broadcast(plain(model))

    def run(batches):
        table, own = Table(), restored(*packed.value)
        for b in slices(batches):
            found = scores(own, b[1].to_pylist(), table)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(found, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, columns unchanged."""
    packed = docs.sparkSession.sparkContext.broadcast(plain(model))

    def run(batches):
        table, own = Table(), restored(*packed.value)
        for b in slices(batches):
            given = ["" if t is None else t for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(scores(own, given, table) < threshold))

    return docs.mapInArrow(run, docs.schema)
